"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table
from tessera.operators.ranges import by_range, cuts_of, range_of

#: Bins (a power of two) and low-order bits kept of each; eight bits make a byte, so a long holds eight bins.
BINS, BITS = 256, 8
SHINGLE = 5
#: Tries to fill an empty bin before all full ones are looked at.
PROBES = 8
_ONES = 0x0101010101010101


def _let(value: str, name: str, body: str) -> str:
    """Evaluates ``value`` once and binds it in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def mix_pair(a: int, b: int) -> int:
    """A fixed 64-bit hash of two small numbers."""
    x = (a * 0x9E3779B97F4A7C15 + (b + 1) * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * k) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def fingerprint(text: str, *, bins: int = BINS, size: int = SHINGLE) -> str:
    """SQL for the packed fingerprint (array of longs) of a text expression; empty for a text without words.

    Words are runs without white space, lower-cased; shingles are ``size`` words, or all of a shorter text.  A
    shingle's hash names its bin by its high bits; a bin keeps the least of its hashes.  An empty bin takes the value
    of a full one, chosen by hashing the pair of bins: uniform over the full bins, and alike for all texts in which
    the same bins are full.  Each bin then keeps its 8 low-order bits.
    """
    shift = 64 - (bins.bit_length() - 1)
    step = (1 << 64) // bins
    hashed = (
        "transform(array(transform(array(btrim(lower({0}), '\\t\\n\\u000B\\u000C\\r ')), t -> if(t = '', cast(array() as array<bigint>), "
        "transform(split(t, '[\\\\x09-\\\\x0D\\\\x20]+'), w -> xxhash64(w))))[0]), w -> "
        "if(size(w) = 0, cast(array() as array<bigint>), if(size(w) < {1}, array(xxhash64(array_join(transform(w, x -> cast(x as string)), ' '))), "
        "transform(slice(w, 1, size(w) - {2}), (x, i) -> xxhash64(x, {3})))))[0]"
    ).format(text, size, size - 1, ", ".join(f"get(w, i + {k})" for k in range(1, size)))
    # A mark at the top of each bin stands for an empty one: after sorting, the first of each bin is its least.
    marks = "cast(split('" + ",".join(str(b * step + step - 1) for b in range(-bins // 2, bins // 2)) + "', ',') as array<bigint>)"
    first = _let(f"sort_array(concat(h, {marks}))", "a", f"filter(a, (x, i) -> i = 0 or shiftright(x, {shift}) <> shiftright(get(a, i - 1), {shift}))")
    # Universal hashes of the bin's number are tried in turn; where all tries meet empty bins, the full bin with the
    # least hash of the pair is taken, which is uniform too.
    probes = ["cast(split('" + ",".join(str(mix_pair(b, t) % bins) for b in range(bins)) + "', ',') as array<int>)" for t in range(PROBES)]
    tries = ", ".join(f"get(v, get({q}, b))" for q in probes)
    full = f"filter(sequence(0, {bins - 1}), k -> get(v, k) is not null)"
    last = f"get(v, cast(array_min(transform(f, k -> (xxhash64(b, k) & {-bins}L) | k)) & {bins - 1}L as int))"
    filled = _let(f"transform(m, x -> if((x & {step - 1}L) <> {step - 1}L, x, null))", "v", _let(full, "f", f"transform(v, (x, b) -> coalesce(x, {tries}, {last}))"))
    dense = f"if(exists(m, x -> (x & {step - 1}L) = {step - 1}L), {filled}, m)"
    packed = _let(dense, "d", f"transform(sequence(0, {bins // 8 - 1}), q -> " + " | ".join(f"shiftleft(get(d, q * 8 + {k}) & 255L, {8 * k})" for k in range(8)) + ")")
    return _let(hashed, "h", f"if(size(h) = 0, cast(array() as array<bigint>), {_let(first, 'm', packed)})")


def likeness(a: str, b: str, *, bins: int = BINS) -> str:
    """SQL for the estimated Jaccard similarity of two packed fingerprints: the share of equal bins, corrected for chance, from 0 to 1.

    Two empty ones are alike; an empty one and another are not.
    """
    # The bits of each byte are gathered in its lowest, which is then set where the bytes differ.
    fold = lambda v, k: f"transform(array({v}), v -> v | shiftrightunsigned(v, {k}))[0]"
    same = f"aggregate(zip_with({a}, {b}, (x, y) -> 8 - bit_count({fold(fold(fold('x ^ y', 4), 2), 1)} & {_ONES}L)), 0, (s, n) -> s + n)"
    chance = 1.0 / (1 << BITS)
    exact = f"greatest(0D, least(1D, ({same} / {float(bins)}D - {chance}D) / {1 - chance}D))"
    return f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else {exact} end"


def as_text(packed: str) -> str:
    return f"array_join(transform({packed}, x -> lpad(hex(x), 16, '0')), '')"


def fingerprints(docs: DataFrame, *, text_col: str = "text", out: str = "fingerprint", bins: int = BINS, size: int = SHINGLE) -> DataFrame:
    """Adds ``out``, the fingerprint of each whole text as hexadecimal text (null or empty: an empty one).

    Equal texts have equal fingerprints; repeated rows each get theirs; a column of that name is replaced.
    """
    return docs.withColumn(out, F.expr(as_text(fingerprint(f"coalesce(`{text_col}`, '')", bins=bins, size=size))))


def next_rows(docs: DataFrame, key: str, buckets: int) -> DataFrame:
    """Adds ``next``: the row (a struct) with the next smaller ``key``, or for the last one the first.

    Rows are dealt into ranges of the key by quantiles, so no task orders all of them.  A range's first row also goes,
    as a ghost, to the end of the range before it.  Nulls come last; ties are ordered by the other columns.
    """
    columns = docs.columns
    cuts = cuts_of(docs, key, buckets)
    own = docs.withColumn("__range", F.expr(range_of(key, cuts)))
    # The first key of each range that has rows: a row per range.
    tops = {r["__range"]: r["top"] for r in own.groupBy("__range").agg(F.max(key).alias("top")).collect()}
    order = sorted((k for k in tops if k <= len(cuts)), reverse=True) + [k for k in tops if k > len(cuts)]
    ahead = {r: order[i - 1] for i, r in enumerate(order)}
    count = len(cuts) + 2
    top = f"if(__range > {len(cuts)}, null, {by_range({k: v for k, v in tops.items() if v is not None}, count, '__range')})"
    rest = [c for c in columns if c != key]
    w = Window.partitionBy("__range").orderBy(F.col(key).desc_nulls_last(), *rest)
    first = own.where(F.expr(f"`{key}` <=> {top}")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    ghosts = first.withColumn("__range", F.expr(f"cast({by_range(ahead, count, '__range')} as int)")).withColumn("__ghost", F.lit(True))
    both = own.withColumn("__ghost", F.lit(False)).unionByName(ghosts)
    w = Window.partitionBy("__range").orderBy("__ghost", F.col(key).desc_nulls_last(), *rest)
    return both.withColumn("next", F.lead(F.struct(*columns)).over(w)).where("not __ghost").drop("__ghost", "__range")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr("coalesce(text, '')").alias("text"))
    docs = docs.withColumn("packed", F.expr(fingerprint("text")))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = next_rows(docs, "doc_id", ranges).withColumn("n_chars", F.expr("cast(length(text) as bigint)"))
    both = both.withColumn("half", F.expr("cast(n_chars div 2 as int)"))
    both = both.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - half), substring(next.text, 1, half))"))
    both = both.withColumn("edited_packed", F.expr(fingerprint("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(as_text("packed")).alias("fingerprint"), F.expr(as_text("edited_packed")).alias("edited_fingerprint"),
        F.expr(likeness("packed", "edited_packed")).alias("near_edited"), F.expr(likeness("packed", "next.packed")).alias("near_next"),
    )
