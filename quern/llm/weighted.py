"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For sample d, hashes of (term, d) give r and c from
Gamma(2, 1) and b from (0, 1); a term of weight w has t = floor(ln w / r + b) and the value ln c - r (t - b + 1), and the
sample is the (term, t) of least value. Two texts agree in a sample with a probability that is their generalised Jaccard
similarity (sum of lesser weights over sum of greater ones), so the share of samples that agree estimates it.

How it runs: each text goes by one exchange to where its samples are taken; the beginning of the document after it comes by
another. Terms of a text and of its edited form are counted together, in the same exchange, so a term's r, c and b
serve both, and least values are min_by aggregates. Samples are taken SIDE at a time, which keeps the generated code of
a stage small enough to be compiled. Neighbours come from ranges of doc_id: the last row of a range belongs before the first
of the next one, a table of one row per range. Rows are told apart by their place in the table, so that no doc_id or
group of copies is gathered; a copy's samples are taken again.

Defined results: null, empty and blank texts have no terms and a fingerprint of zeros, which is wholly like another such
one; very long texts are ordinary; rows of equal doc_id follow each other by text and then by place, null doc_id first;
the only document is its own next one; other columns take no part; an empty table gives no rows. Words are told apart by
64-bit hashes, samples by 32-bit ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLES = 64
SIDE = 4  # samples of one generated stage
PART = 4  # of a text, the last that an edited one replaces
_BREAKS = "[ \\x09-\\x0D]+"
_ABOVE, _FRACTION = 512, 20  # values lie within 512 of zero, and are compared to 20 binary places


def with_next(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (row, text), and (row, doc_id, n_chars, next, before, wanted): the rows after and before each in ascending doc_id, around the end, and how many characters the one before wants of this."""
    text = F.coalesce("text", F.lit(""))
    texts = stored(documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "texts")
    thin = texts.select("row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("hash"))
    order = ("doc_id", "hash", "row")
    ordered = stored(thin.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "doc_id", "n_chars", F.monotonically_increasing_id().alias("place")), "order").withColumn("part", F.shiftrightunsigned("place", 33))
    spots = ordered.groupBy("part").agg(F.min_by("row", "place").alias("first"), F.max_by(F.struct("row", "n_chars"), "place").alias("last"))  # a row per range
    around = Window.orderBy("part")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spots = spots.select("part", F.coalesce(F.lead("first").over(around), F.first("first").over(whole)).alias("following"), F.coalesce(F.lag("last").over(around), F.last("last").over(whole)).alias("preceding"))
    within = Window.partitionBy("part").orderBy("place")
    links = ordered.withColumns({"after": F.lead("row").over(within), "lagged": F.lag(F.struct("row", "n_chars")).over(within)}).join(spots, "part")
    before = F.coalesce("lagged", "preceding")
    links = links.select("row", "doc_id", "n_chars", F.coalesce("after", "following").alias("next"), before["row"].alias("before"), F.floor(before["n_chars"] / PART).cast("int").alias("wanted"))
    return texts.select("row", "text"), stored(links, "links")


def edited_texts(texts: DataFrame, links: DataFrame) -> DataFrame:
    """row, text and edited: the last quarter replaced by as much of the next text's beginning. Numbers come from links, so that all that needs texts needs the same exchange of them."""
    heads = texts.join(links.select("row", "before", "wanted"), "row").select(F.col("before").alias("row"), F.substring("text", F.lit(1), F.col("wanted")).alias("head"))
    kept = F.substring("text", F.lit(1), (F.col("n_chars") - F.floor(F.col("n_chars") / PART)).cast("int"))
    return texts.join(links.select("row", "n_chars"), "row").join(heads, "row").select("row", "text", F.concat(kept, "head").alias("edited"))


def weights(texts: DataFrame) -> DataFrame:
    """row, term, log0 and log1: the logarithms of a term's weights in text and edited, null where it isn't there."""
    forms = F.explode(F.array(F.struct(F.lit(0).alias("form"), F.col("text").alias("words")), F.struct(F.lit(1).alias("form"), F.col("edited").alias("words"))))
    words = texts.select("row", forms.alias("f")).select("row", "f.form", F.explode(F.split("f.words", _BREAKS)).alias("word")).filter("word <> ''")
    counted = words.groupBy("row", F.xxhash64("word").alias("term")).agg(F.count(F.when(F.col("form") == 0, 1)).alias("n0"), F.count(F.when(F.col("form") == 1, 1)).alias("n1"))
    log = lambda n: F.when(F.col(n) > 0, F.ln(n))
    return counted.select("row", "term", log("n0").alias("log0"), log("n1").alias("log1"))


def _uniform(bits: Column, n: int) -> Column:
    """n bits as a number between 0 and 1."""
    return (bits.cast("double") + 0.5) * (2.0**-n)


def samples(terms: DataFrame, n: int = SAMPLES) -> DataFrame:
    """row, samples0 and samples1: n numbers of 32 bits for each of the two texts (null where one has no terms). Value and sample are one number, the value above, so that a least sample is a plain minimum."""
    sides = F.explode(F.array(*(F.lit(s) for s in range(n // SIDE))))
    rows = terms.select("row", "term", "log0", "log1", sides.alias("side"))
    low = F.lit((1 << 32) - 1)
    hashes, draws, least = {}, {}, []
    for d in range(SIDE):
        hashes[f"h{d}"], hashes[f"g{d}"] = F.xxhash64("term", "side", F.lit(2 * d)), F.xxhash64("term", "side", F.lit(2 * d + 1))
    for d in range(SIDE):
        h, g = F.col(f"h{d}"), F.col(f"g{d}")
        u = [_uniform(F.shiftrightunsigned(g, at).bitwiseAND(F.lit((1 << 21) - 1)), 21) for at in (0, 21, 42)]
        draws[f"r{d}"] = -F.ln(_uniform(F.shiftrightunsigned(h, 32), 32) * _uniform(h.bitwiseAND(low), 32))
        draws[f"c{d}"] = F.ln(-F.ln(u[0] * u[1]))
        draws[f"b{d}"] = u[2]
    rows = rows.withColumns(hashes).withColumns(draws)
    rows = rows.withColumns({f"t{d}_{form}": F.floor(F.col(f"log{form}") / F.col(f"r{d}") + F.col(f"b{d}")) for d in range(SIDE) for form in (0, 1)})
    for form in (0, 1):
        for d in range(SIDE):
            t = F.col(f"t{d}_{form}")
            value = F.floor((F.col(f"c{d}") - F.col(f"r{d}") * (t - F.col(f"b{d}") + 1) + _ABOVE) * (1 << _FRACTION))
            sample = F.col("term").bitwiseXOR(F.shiftleft(t, 16)).bitwiseAND(low)
            least.append(F.min(F.shiftleft(value, 32).bitwiseOR(sample)).bitwiseAND(low).alias(f"s{form}_{d}"))
    found = rows.groupBy("row", "side").agg(*least)
    some = lambda form: F.when(F.col(f"s{form}_0").isNotNull(), F.array(*(F.col(f"s{form}_{d}") for d in range(SIDE))))
    sides = F.array_sort(F.collect_list(F.struct("side", some(0).alias("s0"), some(1).alias("s1"))))  # n / SIDE of them
    both = found.groupBy("row").agg(sides.alias("sides"))
    return both.select("row", *(F.when(F.col(f"sides.s{form}")[0].isNotNull(), F.flatten(f"sides.s{form}")).alias(f"samples{form}") for form in (0, 1)))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.size(a)


def written(samples: Column) -> Column:
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def weighted_fingerprints(documents: DataFrame, n: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    texts, links = with_next(documents)
    edited = edited_texts(texts, links)
    taken = samples(weights(edited), n)
    none = F.array_repeat(F.lit(0).cast("long"), n)
    digests = edited.select("row", F.sha2("edited", 256).alias("edited_sha256"))
    own = links.select("row", "doc_id", "n_chars", "next").join(digests, "row").join(taken, "row", "left")
    own = stored(own.select("row", "doc_id", "n_chars", "next", "edited_sha256", F.coalesce("samples0", none).alias("own"), F.coalesce("samples1", none).alias("changed")), "samples")
    after = own.select(F.col("row").alias("next"), F.col("own").alias("following"))
    both = own.join(after, "next")
    return both.select("doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
