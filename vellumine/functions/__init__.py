"""Part of vellumine; see the README for the map of packages."""
