"""Problem 6: nested layout records as related flat tables with Merkle subtree identities.

Every object (page, bundle, token) gets a content hash, computed bottom-up: a token's over its own
fields, a bundle's over its fields and its tokens' hashes, a page's over its fields and the hashes of
its bundles and remaining tokens. Identical subtrees have one identity and are stored once; bridge
rows keep every occurrence: parent hash, child hash, role and ordinal. Occurrence rows place each
object in its record.

Typed layouts stay in the JVM. Raw payloads come in many container forms and are brought into the
typed form in Arrow batches first; both then take the same path.

Defined results: null objects keep their ordinal but give no row; null and empty containers give no
rows; a record without pages gives no rows; payloads that are no complete JSON, or whose pages are
missing or a mere number, give none; unknown fields are ignored and numbers may be text; a field
that can't be read as its type becomes null; repeated records are separate occurrences of the same
identities; extra columns aren't read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.session import Stored, materialise, spread

TOKEN = T.StructType([
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("confidence", T.DoubleType())])
BUNDLE = T.StructType([
    T.StructField("bbox", T.ArrayType(T.DoubleType())), T.StructField("type", T.StringType()),
    T.StructField("confidence", T.DoubleType()), T.StructField("tokens", T.ArrayType(TOKEN))])
LAYOUT = T.StructType([
    T.StructField("bundles", T.ArrayType(BUNDLE)), T.StructField("remaining_tokens", T.ArrayType(TOKEN))])
PAGE = T.StructType([
    T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType()),
    T.StructField("index", T.IntegerType()), T.StructField("layout", LAYOUT)])
RECORD = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("paper_sha", T.StringType()),
    T.StructField("pages", T.ArrayType(PAGE))])


# ---- raw payloads ---------------------------------------------------------------------------


def _load(value: object) -> object:
    """Undo JSON text, however often it was wrapped."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value


def _number(value: object) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        out = float(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return out if out - out == 0 else None


def _int_key(key: str) -> int | None:
    try:
        return int(key)
    except ValueError:
        return None


def _container(value: object) -> list | None:
    """An array in any of its forms: array, lone object, object keyed by integers, JSON text.

    An object without keys is an array without entries.
    """
    value = _load(value)
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        keys = [_int_key(k) for k in value]
        if all(k is not None for k in keys):
            return [v for _, v in sorted(zip(keys, value.values(), strict=True), key=lambda kv: kv[0])]
        return [value]
    return None


def _object(value: object) -> dict | None:
    value = _load(value)
    return value if isinstance(value, dict) else None


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _bbox(value: object) -> list[float | None] | None:
    value = _load(value)
    return [_number(v) for v in value] if isinstance(value, list) else None


def _token(value: object) -> dict | None:
    o = _object(value)
    if o is None:
        return None
    return {"bbox": _bbox(o.get("bbox")), "text": _text(o.get("text")), "type": _text(o.get("type")),
            "confidence": _number(o.get("confidence"))}


def _bundle(value: object) -> dict | None:
    o = _object(value)
    if o is None:
        return None
    tokens = _container(o.get("tokens"))
    return {"bbox": _bbox(o.get("bbox")), "type": _text(o.get("type")), "confidence": _number(o.get("confidence")),
            "tokens": tokens and [_token(t) for t in tokens]}


def _page(value: object) -> dict | None:
    o = _object(value)
    if o is None:
        return None
    layout = _object(o.get("layout"))
    if layout is not None:
        bundles, rest = _container(layout.get("bundles")), _container(layout.get("remaining_tokens"))
        layout = {"bundles": bundles and [_bundle(b) for b in bundles],
                  "remaining_tokens": rest and [_token(t) for t in rest]}
    index = _number(o.get("index"))
    return {"width": _number(o.get("width")), "height": _number(o.get("height")),
            "index": int(index) if index is not None and abs(index) < 2**31 else None, "layout": layout}


def parse_payload(payload: str | None) -> tuple[str | None, list | None]:
    """``(paper_sha, pages)`` of one payload; pages None where it has none."""
    record = _load(payload)
    if isinstance(record, dict) and "pages" not in record and len(record) == 1:
        record = _load(next(iter(record.values())))  # one outer key
    if not isinstance(record, dict):
        return None, None
    pages = _container(record.get("pages"))
    return _text(record.get("paper_sha")), pages and [_page(p) for p in pages]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        parsed = [parse_payload(p) for p in pdf["payload"]]
        yield pd.DataFrame({"record_id": pdf["record_id"], "paper_sha": [s for s, _ in parsed], "pages": [p for _, p in parsed]})


def typed_records(raw: DataFrame) -> DataFrame:
    """Raw ``(record_id, payload)`` in the typed form of the layouts."""
    rows = spread(raw.select("record_id", "payload").where("payload IS NOT NULL"), "record_id")
    return rows.mapInPandas(_parse_batches, RECORD)


# ---- Merkle identities ----------------------------------------------------------------------


def _canonical(kind: str, fields: list[Column]) -> Column:
    """Hash over the fields in fixed order; lengths are marked, so no two contents run together."""
    parts = [F.lit(kind)]
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("~")))
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)  # 128 bits


def _numbers(box: Column) -> Column:
    return F.array_join(F.transform(box, lambda v: F.coalesce(v.cast("string"), F.lit("~"))), ",")


def _token_hash(t: Column) -> Column:
    return _canonical("token", [_numbers(t["bbox"]), t["text"], t["type"], t["confidence"]])


def _hashes(objects: Column) -> Column:
    """Ordered child hashes; null children keep their place; a null container differs from an empty one."""
    return F.array_join(F.transform(objects, lambda o: F.coalesce(o["id"], F.lit("~"))), ",")


def _identified_tokens(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.isNotNull(), F.struct(_token_hash(t).alias("id"), t.alias("value"))))


def _identified_bundle(b: Column) -> Column:
    return F.when(b["value"].isNotNull(), F.struct(
        _canonical("bundle", [_numbers(b["value"]["bbox"]), b["value"]["type"], b["value"]["confidence"], _hashes(b["tokens"])]).alias("id"),
        b["value"].dropFields("tokens").alias("value"), b["tokens"].alias("tokens")))


def identified(records: DataFrame, src: str) -> DataFrame:
    """One row per record, page and non-null page object, hashes attached at every level."""
    pages = records.select(F.lit(src).alias("src"), "record_id", "paper_sha", F.posexplode("pages").alias("page_pos", "page")).where("page IS NOT NULL")
    with_tokens = F.transform("page.layout.bundles", lambda b: F.struct(b.alias("value"), _identified_tokens(b["tokens"]).alias("tokens")))
    out = (pages.withColumn("_b", with_tokens)
           .withColumn("bundles", F.transform("_b", _identified_bundle))
           .withColumn("remaining", _identified_tokens(F.col("page.layout.remaining_tokens"))))
    page_id = _canonical("page", [F.col("page.width"), F.col("page.height"), F.col("page.index"), _hashes(F.col("bundles")), _hashes(F.col("remaining"))])
    return out.select("src", "record_id", "paper_sha", "page_pos", page_id.alias("page_id"),
                      F.col("page.width").alias("width"), F.col("page.height").alias("height"), F.col("page.index").alias("index"),
                      "bundles", "remaining")


def occurrences(pages: DataFrame) -> DataFrame:
    """Every non-null object in its place, linked to its parent and its record.

    ``(src, record_id, lvl, page_pos, bundle_pos, token_pos, object_id, parent_id)``; the levels of a
    page come from one pass over the page, not from a scan for each level.
    """
    none = F.lit(-1)

    def item(lvl: str, bundle: Column, token: Column, own: Column, parent: Column) -> Column:
        return F.struct(F.lit(lvl).alias("lvl"), bundle.cast("int").alias("bundle_pos"), token.cast("int").alias("token_pos"),
                        own.alias("object_id"), parent.alias("parent_id"))

    page = F.array(item("page", none, none, F.col("page_id"), F.lit(None).cast("string")))
    bundles = F.transform("bundles", lambda b, i: item("bundle", i, none, b["id"], F.col("page_id")))
    tokens = F.flatten(F.transform("bundles", lambda b, i: F.coalesce(
        F.transform(b["tokens"], lambda t, j: item("token", i, j, t["id"], b["id"])), F.array().cast(_ITEMS))))
    rest = F.transform("remaining", lambda t, j: item("remaining", none, j, t["id"], F.col("page_id")))
    empty = F.array().cast(_ITEMS)
    every = F.concat(page, F.coalesce(bundles, empty), F.coalesce(tokens, empty), F.coalesce(rest, empty))
    return (pages.select("src", "record_id", "page_pos", F.explode(F.filter(every, lambda o: o["object_id"].isNotNull())).alias("o"))
            .select("src", "record_id", "o.lvl", "page_pos", "o.bundle_pos", "o.token_pos", "o.object_id", "o.parent_id"))


_ITEMS = "array<struct<lvl:string,bundle_pos:int,token_pos:int,object_id:string,parent_id:string>>"


def bridge(occ: DataFrame) -> DataFrame:
    """Parent-child links between identities with role and ordinal, each stored once."""
    ordinal = F.when(F.col("lvl") == "bundle", F.col("bundle_pos")).otherwise(F.col("token_pos"))
    return occ.where("parent_id IS NOT NULL").select("parent_id", "object_id", F.col("lvl").alias("role"), ordinal.alias("ordinal")).distinct()


def records_table(records: DataFrame, src: str) -> DataFrame:
    """One row per record ``(src, record_id, paper_sha, pages)`` with its non-null pages counted; the bond to its paper."""
    pages = F.coalesce(F.size(F.filter("pages", lambda p: p.isNotNull())), F.lit(0))
    return records.select(F.lit(src).alias("src"), "record_id", "paper_sha", F.greatest(pages, F.lit(0)).alias("pages"))


def pages_table(pages: DataFrame) -> DataFrame:
    """One row per page identity."""
    return pages.select("page_id", "width", "height", "index").dropDuplicates(["page_id"])


def bundles_table(pages: DataFrame) -> DataFrame:
    """One row per bundle identity."""
    return (pages.select(F.explode("bundles").alias("b")).where("b IS NOT NULL")
            .select(F.col("b.id").alias("bundle_id"), "b.value.bbox", "b.value.type", "b.value.confidence").dropDuplicates(["bundle_id"]))


def tokens_table(pages: DataFrame) -> DataFrame:
    """One row per token identity, of bundles and of remaining tokens."""
    every = F.concat(F.coalesce(F.flatten(F.filter(F.transform("bundles", lambda b: b["tokens"]), lambda t: t.isNotNull())), F.array().cast(_TOKENS)),
                     F.coalesce("remaining", F.array().cast(_TOKENS)))
    return (pages.select(F.explode(every).alias("t")).where("t IS NOT NULL")
            .select(F.col("t.id").alias("token_id"), "t.value.*").dropDuplicates(["token_id"]))


_TOKENS = f"array<struct<id:string,value:{TOKEN.simpleString()}>>"


def stored(pages: DataFrame) -> dict[str, DataFrame]:
    """The related tables of identified pages, each stored: ``roots``, ``pages``, ``bundles``, ``tokens``, ``bridge``."""
    base = Stored(pages)
    tables = {"roots": base.df.select("src", "record_id", "page_pos", "page_id"), "pages": pages_table(base.df), "bundles": bundles_table(base.df),
              "tokens": tokens_table(base.df), "bridge": bridge(occurrences(base.df))}
    tables = {name: materialise(t) for name, t in tables.items()}
    base.drop()
    return tables


def rebuilt(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``occurrences`` from the pages of the records and the bridge."""
    none, place = F.lit(-1), ["src", "record_id", "page_pos"]
    page = roots.select("src", "record_id", F.lit("page").alias("lvl"), "page_pos", none.alias("bundle_pos"), none.alias("token_pos"),
                        F.col("page_id").alias("object_id"), F.lit(None).cast("string").alias("parent_id"))
    below = roots.join(links.where("role <> 'token'"), F.col("page_id") == F.col("parent_id"))
    bundle = F.col("role") == "bundle"
    inner = below.select("src", "record_id", F.col("role").alias("lvl"), "page_pos", F.when(bundle, F.col("ordinal")).otherwise(none).alias("bundle_pos"),
                         F.when(bundle, none).otherwise(F.col("ordinal")).alias("token_pos"), "object_id", "parent_id")
    bundles = below.where(bundle).select(*place, F.col("ordinal").alias("bundle_pos"), F.col("object_id").alias("bundle_id"))
    tokens = bundles.join(links.where("role = 'token'"), F.col("bundle_id") == F.col("parent_id")).select(
        "src", "record_id", F.col("role").alias("lvl"), "page_pos", "bundle_pos", F.col("ordinal").alias("token_pos"), "object_id", "parent_id")
    return page.unionByName(inner).unionByName(tokens)


def found(occ: DataFrame) -> DataFrame:
    return occ.select("src", "record_id", "lvl", "page_pos", "bundle_pos", "token_pos")
