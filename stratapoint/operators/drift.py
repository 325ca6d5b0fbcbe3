"""Schemas that drift from file to file: one tagged-union schema, a typed table and a report of changes.

Each file brings its own list of ``(name, dtype)`` fields. A *path* of the union schema is a quantity; all names that mean
it are its spellings and all NumPy dtypes seen are its alternatives, which are kept side by side (as typed branches) beside
one canonical column that every alternative converts to without loss of the value's meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratapoint.session import newest, numbered

# NumPy spellings of scalar types by kind and size in bytes.
NUMPY_NAMES = {
    "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8",
    "uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8",
    "float16": "f2", "float32": "f4", "float64": "f8", "bool": "b1",
}

#: Neighbouring files whose schemas are fused in one group; each block also sees the file before its first.
BLOCK = 256
#: Columns of the wide table that one aggregation makes; a schema of more is built in several, joined on the point.
WIDTH = 500


def spelling_key(name: Column) -> Column:
    """``name`` in lower case with all but letters and digits dropped; a name without any stands for itself."""
    bare = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return F.when(bare == "", F.trim(name)).otherwise(bare)


def type_key(dtype: Column) -> Column:
    """Kind and size of a NumPy dtype, as ``u2``: byte order and long names don't count."""
    bare = F.regexp_replace(F.lower(F.trim(dtype)), r"^[<>|=]", "")
    known = F.create_map(*[F.lit(x) for pair in NUMPY_NAMES.items() for x in pair])
    return F.coalesce(known[bare], bare, F.lit(""))


def quantities(terms: DataFrame) -> DataFrame:
    """Spelling keys and the quantity each means. Of a term listed under several quantities the first by name counts.

    A quantity's own name that is not among its terms stands for itself; it is told apart by a trailing ``_``.
    """
    known = terms.where("term is not null and quantity is not null")
    own = known.select(spelling_key(F.col("quantity")).alias("key"), F.concat("quantity", F.lit("_")).alias("quantity"), F.lit(1).alias("rank"))
    meant = known.select(spelling_key(F.col("term")).alias("key"), "quantity", F.lit(0).alias("rank"))
    return meant.unionByName(own).groupBy("key").agg(F.min(F.struct("rank", "quantity"))["quantity"].alias("quantity"))


def newest_files(metadata: DataFrame) -> DataFrame:
    return newest(metadata.select("file_id", "series_id", "delivered_at", "extra_fields", "loaded_at"), "file_id", "loaded_at")


def tagged_union(metadata: DataFrame, terms: DataFrame) -> DataFrame:
    """The schemas of all files fused: one row per block of ``BLOCK`` neighbouring files, series and path (quantity).

    Columns: block, series_id, quantity, steps. ``steps`` keeps the path's alternative in every file of the block that has it,
    in the files' order: at (the file's place among all), file_id, delivered_at, before and after (the files of the series
    around it in this block, null at its edges), name, type. The last file before the block stands in front, as the base that
    its first file is fused with. Blocks are fused apart from each other (a prefix order of all files cuts them, so a series of
    very many files is many blocks), and whatever is asked of the whole union is an aggregate over blocks.

    Files with null fields are no schemas; entries without a name are no fields; where one file lists a quantity several
    times, the first entry counts.
    """
    readable = newest_files(metadata).where("extra_fields is not null").select("series_id", "delivered_at", "file_id", "extra_fields")
    placed = numbered(readable, "at", "series_id", "delivered_at", "file_id")
    block = F.expr(f"at div {BLOCK}")
    twice = F.when((F.col("at") + 1) % BLOCK == 0, F.array(block, block + 1)).otherwise(F.array(block))
    around = Window.partitionBy("block", "series_id").orderBy("at")  # at most BLOCK + 1 files
    files = placed.withColumn("block", F.explode(twice)).withColumns({"before": F.lag("file_id").over(around), "after": F.lead("file_id").over(around)})
    of = ("block", "series_id", "at", "file_id", "delivered_at", "before", "after")
    entries = files.select(*of, F.posexplode("extra_fields").alias("place", "f")).where("f.name is not null")
    named = entries.select(*of, "place", F.trim("f.name").alias("name"), type_key(F.col("f.dtype")).alias("type"), spelling_key(F.col("f.name")).alias("key"))
    # the term list is a dictionary of the field: the optimizer broadcasts it if its size is small, else it shuffles
    known = named.join(quantities(terms), "key", "left").withColumn("quantity", F.coalesce("quantity", "key"))
    step = F.struct("at", "place", *of[3:], "name", "type")
    fused = known.groupBy("block", "series_id", "quantity").agg(F.array_sort(F.collect_list(step)).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (F.get(F.col("s"), i - 1)["at"] != x["at"]))
    return fused.select("block", "series_id", "quantity", first.alias("steps"))


def drift_report(metadata: DataFrame, terms: DataFrame) -> DataFrame:
    """Changes of each file against the readable file before it: file_id, change, old_name, new_name.

    Read off the tagged union: a path's alternative that has none in the file before appears (``added``), one that has none in
    the file after is gone from there (``removed``), and two that follow each other are compared (``renamed``, ``retyped``).
    Files with null fields are passed over; an empty list is a file without fields. Files without a series have no file before
    them. Empty tables give no rows.
    """
    union = tagged_union(metadata, terms).where("series_id is not null")

    def changes(x: Column, i: Column) -> Column:
        last, following = F.get(F.col("steps"), i - 1), F.get(F.col("steps"), i + 1)
        held = last["at"] == x["at"] - 1
        inside = x["at"] >= F.col("block") * BLOCK  # else it is the base in front of the block
        change = lambda kind, when, file, old, new: F.when(when, F.struct(file.alias("file_id"), F.lit(kind).alias("change"), old.alias("old_name"), new.alias("new_name")))
        none = F.lit("")
        return F.array(
            change("added", inside & x["before"].isNotNull() & F.coalesce(~held, F.lit(True)), x["file_id"], none, x["name"]),
            change("renamed", held & (last["name"] != x["name"]), x["file_id"], last["name"], x["name"]),
            change("retyped", held & (last["type"] != x["type"]), x["file_id"], last["name"], x["name"]),
            change("removed", x["after"].isNotNull() & F.coalesce(following["at"] != x["at"] + 1, F.lit(True)), x["after"], x["name"], none),
        )

    return union.select(F.explode(F.flatten(F.transform("steps", changes))).alias("c")).where("c is not null").select("c.*")


WHOLE = r"^([iu][124]|i8|b1)$"


def union_schema(metadata: DataFrame, terms: DataFrame) -> DataFrame:
    """The tagged union over all files: quantity, its spellings, its alternative types with the files of each, the canonical type.

    Columns: quantity, spellings, alternatives (array of type, first_file and last_file by delivery, n_files), canonical:
    boolean where every alternative is, bigint where every one is a whole number that fits, decimal(20,0) where whole numbers
    may need it, else double.
    """
    union = tagged_union(metadata, terms)
    own = union.select("block", "quantity", F.explode("steps").alias("s")).where(F.col("s.at") >= F.col("block") * BLOCK)
    when = F.struct("s.delivered_at", "s.file_id")
    by_type = own.groupBy("quantity", "s.type").agg(
        F.count(F.lit(1)).alias("n_files"), F.min(when)["file_id"].alias("first_file"), F.max(when)["file_id"].alias("last_file"), F.collect_set("s.name").alias("names")
    )
    every = lambda pattern: F.min(F.col("type").rlike(pattern))
    return by_type.groupBy("quantity").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("spellings"),
        F.array_sort(F.collect_list(F.struct("type", "first_file", "last_file", "n_files"))).alias("alternatives"),
        F.when(every("^b1$"), "boolean").when(every(WHOLE), "bigint").when(every(r"^([iu][1248]|b1)$"), "decimal(20,0)").otherwise("double").alias("canonical"),
    )


def tagged_values(samples: DataFrame, terms: DataFrame) -> DataFrame:
    """Every value of the payloads, split into typed branches: file_id, point_no, quantity, tag, whole, big, real, flag, text.

    tag tells the branch a value stands in: ``whole`` (bigint), ``big`` (whole numbers beyond it, of up to 38 digits), ``real``
    (double), ``flag`` (true or false), ``text`` or ``null``. Numbers spelled as strings go to the branch of the number; whole
    numbers of more than 38 digits are real. Repeated rows count once. A payload that is no JSON object gives no values. If one
    payload holds a quantity twice, the first by field name counts.
    """
    parsed = samples.where("payload is not null").select("file_id", "point_no", F.from_json("payload", "map<string,string>").alias("p")).where("p is not null")
    values = parsed.select("file_id", "point_no", F.explode("p").alias("name", "value")).withColumn("key", spelling_key(F.col("name")))
    known = values.join(quantities(terms), "key", "left").withColumn("quantity", F.coalesce("quantity", "key"))
    one = known.groupBy("file_id", "point_no", "quantity").agg(F.min(F.struct(F.col("value").isNull().alias("empty"), "name", "value"))["value"].alias("value"))
    text = F.trim("value")
    digits = text.rlike(r"^[+-]?[0-9]+$")
    whole = F.when(digits, text.try_cast("bigint"))
    big = F.when(digits & whole.isNull(), text.try_cast("decimal(38,0)"))
    number = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    real = F.when(number & whole.isNull() & big.isNull(), text.try_cast("double"))
    flag = F.when(text == "true", True).when(text == "false", False)
    cases = [("whole", whole), ("big", big), ("real", real), ("flag", flag)]
    tag = F.when(F.col("value").isNull(), "null")
    for name, branch in cases:
        tag = tag.when(branch.isNotNull(), name)
    tag = tag.otherwise("text")
    return one.select("file_id", "point_no", "quantity", tag.alias("tag"), *[b.alias(n) for n, b in cases], F.when(tag == "text", F.col("value")).alias("text"))


def canonical(kind: str) -> Column:
    """A tagged value as the canonical type ``kind``, null where it can't be one without change of meaning.

    true and false are 1 and 0 among numbers; a real number is whole if it has no fraction; other numbers than 0 and 1 are no
    truth values.
    """
    flag, whole, big, real = F.col("flag"), F.col("whole"), F.col("big"), F.col("real")
    as_whole = F.coalesce(whole.cast("decimal(38,0)"), big, F.when(real == F.floor(real), real.try_cast("decimal(38,0)")), flag.cast("int").cast("decimal(38,0)"))
    if kind == "boolean":
        return F.coalesce(flag, F.when(as_whole.isin(0, 1), as_whole == 1))
    if kind == "bigint":
        # exact: the first two never leave bigint
        return F.coalesce(whole, F.when(flag.isNotNull(), flag.cast("bigint")), F.when((real == F.floor(real)) & (F.abs(real) < 2.0**63), real.try_cast("bigint")))
    if kind.startswith("decimal"):
        return as_whole.try_cast(kind)
    if kind == "double":
        return F.coalesce(real, whole.cast("double"), big.cast("double"), flag.cast("double"))
    return F.coalesce("text", whole.cast("string"), big.cast("string"), real.cast("string"), flag.cast("string"))


def table_schema(metadata: DataFrame, samples: DataFrame, terms: DataFrame) -> DataFrame:
    """quantity, canonical: the union schema, and quantities that stand in payloads only, typed by the values they hold.

    Of the latter: boolean of flags alone, bigint of whole numbers, decimal(20,0) or double beyond, string where there is text.
    """
    declared = union_schema(metadata, terms).select("quantity", "canonical")
    seen = tagged_values(samples, terms).groupBy("quantity").agg(
        *[F.max(F.col("tag") == t).alias(t) for t in ("flag", "whole", "real", "text")], F.max(F.abs("big")).alias("big")
    )
    kind = (
        F.when(F.col("text"), "string").when(F.col("real") | (F.col("big") > F.lit("9" * 20).cast("decimal(38,0)")), "double").when(F.col("big").isNotNull(), "decimal(20,0)")
        .when(F.col("flag") & ~F.col("whole"), "boolean").otherwise("bigint")
    )
    return declared.unionByName(seen.join(declared, "quantity", "left_anti").select("quantity", kind.alias("canonical")))


def unified_table(metadata: DataFrame, samples: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per point and one canonical typed column per quantity of :func:`table_schema` (``q_<quantity>``).

    The column list is the schema itself and so must be known to the driver. Values of another kind than the canonical one
    stay in :func:`tagged_values`; here they are null.
    """
    schema = table_schema(metadata, samples, terms).orderBy("quantity").toLocalIterator()
    rows = samples.where("file_id is not null and point_no is not null").select("file_id", "point_no").distinct()
    columns = [F.max(F.when(F.col("quantity") == r.quantity, canonical(r.canonical))).alias(f"q_{r.quantity}") for r in schema]
    values = tagged_values(samples, terms)
    for k in range(0, len(columns), WIDTH):
        rows = rows.join(values.groupBy("file_id", "point_no").agg(*columns[k : k + WIDTH]), ["file_id", "point_no"], "left")
    return rows
