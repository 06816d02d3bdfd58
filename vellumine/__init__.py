"""vellumine: a Spark-first analytics engine for scholarly documents."""
