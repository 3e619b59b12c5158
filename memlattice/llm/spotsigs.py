"""Document fingerprints by spot signatures.

Each common word (an anchor) starts a chain: the anchor and the next CHAIN content words, that is words
which are no anchors. The set of a document's chains is its signature set: prose carries many anchors,
navigation and lists few, so the set describes the prose. A signature is the first 8 hex digits of the MD5 of
a chain's words; the fingerprint is the sorted set of signatures without separators. Likeness is the Jaccard
similarity of two sets.

Defined cases: words are runs of letters and digits after lower-casing. A text
without any chain is described by one signature over its whole word sequence; a text without words has the
empty fingerprint. Two empty sets have likeness 1, an empty and a non-empty one 0. Null text counts as
empty. Repeated rows are fingerprinted alike and follow one another. Only doc_id and text are read, so further columns
can't clash. An empty table gives no rows. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlattice.llm._shared import written

# Very common function words of English, French, German and Spanish.
ANCHORS = (
    "the of and to in a is that it for on was be with as by at are an from this "
    "le la les des et un une du en que dans pour est "
    "der die und das den von zu ist ein nicht mit "
    "el los de y las por con se una para"
).split()
CHAIN = 2
MARK = "\u0001"


def normalized(text: Column) -> Column:
    """Lower-case runs of letters and digits, separated by single blanks."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, as array<string>."""
    return _let(normalized(text), lambda norm: _let(_glued(norm, anchors), lambda tokens: _chains(norm, tokens, chain)))


def _let(value: Column, body) -> Column:
    """body over a value that is computed once; written out, a lambda would compute it anew for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _glued(norm: Column, anchors: list[str]) -> Column:
    """Words, with anchors glued before the content word that follows: "on the mat" -> "on\\x01the\\x01mat"."""
    glued = F.transform(F.split(norm, " "), lambda w: F.concat(w, F.when(w.isin(anchors), F.lit(MARK)).otherwise(F.lit(" "))))
    return F.split(F.rtrim(F.array_join(glued, "")), " ")


def _chains(norm: Column, tokens: Column, chain: int) -> Column:
    last = lambda t: F.substring_index(t, MARK, -1)
    follow = lambda i: F.coalesce(last(F.get(tokens, i)), F.lit(""))
    anchor = lambda t: F.substring_index(F.substring_index(t, MARK, -2), MARK, 1)
    found = F.array_compact(F.transform(
        tokens,
        lambda t, i: F.when(F.instr(t, MARK) > 0, _hashed(F.concat_ws(MARK, anchor(t), *[follow(i + k) for k in range(chain)]))),
    ))
    whole = F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array(_hashed(norm)))
    return _let(F.array_sort(F.array_distinct(found)), lambda f: F.when(F.size(f) > 0, f).otherwise(whole))


def _hashed(words: Column) -> Column:
    return F.substring(F.md5(words), 1, 8)


def fingerprint(sigs: Column) -> Column:
    """The signatures in the order of the set."""
    return F.array_join(sigs, "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity; where the larger set is empty, 1."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def fingerprints(docs: DataFrame, text: str = "text", anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Adds signatures array<string> and fingerprint string to docs (replacing columns of these names)."""
    return docs.withColumn("signatures", signatures(F.col(text), anchors, chain)).withColumn("fingerprint", fingerprint(F.col("signatures")))


BUCKET = 100


def _following(buckets: DataFrame, width: int = 1_000, one_task: int = 200_000) -> DataFrame:
    """(bucket, next): the next larger bucket that exists; null for the last. Many buckets are dealt over coarser ones first."""
    if buckets.count() <= one_task:
        return buckets.select("bucket", F.lead("bucket").over(Window.orderBy("bucket")).alias("next"))
    coarse = written(buckets.withColumn("coarse", F.expr(f"bucket div {width}")), "coarse")
    inner = coarse.withColumn("next", F.lead("bucket").over(Window.partitionBy("coarse").orderBy("bucket")))
    after = _following(coarse.select(F.col("coarse").alias("bucket")).distinct(), width, one_task)
    heads = coarse.groupBy(F.col("coarse").alias("next")).agg(F.min("bucket").alias("head"))
    jump = after.join(heads, "next").select(F.col("bucket").alias("coarse"), "head")
    return inner.join(jump, "coarse", "left").select("bucket", F.coalesce("next", "head").alias("next"))


def with_next(docs: DataFrame, id_col: str, tied: list[str]) -> DataFrame:
    """Each row with the tied columns of the row that follows in ascending id, the first following the last.

    Ids are dealt over buckets of BUCKET consecutive values, so no task orders more than a bucket at a time;
    the first row of each bucket is repeated in the bucket before. Rows of one id (null counts as the least)
    follow one another in the order of the tied columns' hash, then of the columns.
    """
    order = F.coalesce(F.col(id_col), F.lit(-(2**63)))
    rows = docs.withColumn("_o", order).withColumn("_b", F.expr(f"_o div {BUCKET}"))
    bounds = written(rows.groupBy("_b").agg(F.min("_o").alias("_o")), "bounds")
    n = bounds.count()
    follow = _following(bounds.select(F.col("_b").alias("bucket")))
    last, first = bounds.agg(F.max("_b"), F.min("_b")).first()
    before = follow.where("next is not null").select(F.col("next").alias("_b"), F.col("bucket").alias("_to"))
    # A bound is 16 bytes: under 4 MB they are broadcast, beyond that the rows are joined by a shuffle.
    heads = bounds.select("_b", "_o")
    heads = rows.join(F.broadcast(heads) if n <= 250_000 else heads, ["_b", "_o"])
    ties = [F.xxhash64(*tied), *tied]
    heads = heads.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy(*ties))).where("_k = 1").drop("_k")
    ghosts = heads.join(before, "_b").select(*docs.columns, "_o", F.col("_to").alias("_b"), F.lit(True).alias("_ghost"))
    if n:
        wrap = heads.where(F.col("_b") == first).select(*docs.columns, F.lit(2**63 - 1).alias("_o"), F.lit(last).alias("_b"), F.lit(True).alias("_ghost"))
        ghosts = ghosts.unionByName(wrap)
    every = rows.select(*docs.columns, "_o", "_b", F.lit(False).alias("_ghost")).unionByName(ghosts)
    window = Window.partitionBy("_b").orderBy("_o", "_ghost", *ties)
    out = every.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in tied])
    return out.where(~F.col("_ghost")).drop("_o", "_b", "_ghost")


def edited_text(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for doc_id and text."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Only texts are dealt out; signatures are made after that, so no sort carries them.
    rows = with_next(base, "doc_id", ["text"]).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", "text", "edited", *[signatures(F.col(c)).alias(f"{c}_sigs") for c in ("text", "edited", "next_text")])
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("text_sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("text_sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("text_sigs"), F.col("next_text_sigs")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) between classes of different signature sets, members (id, class_id).

    Equal sets form one class, named by its smallest id, so groups of copies cost nothing. Sets are dealt by
    length: partition j holds lengths from t^-j to t^-(j+1), and a set can only be similar to sets of its own
    and the neighbouring partitions. Within them, sets share one of their rarest signatures (as many as can be
    missed under the threshold, plus one). Lengths prune again, then the exact Jaccard decides. Empty sets are in no pair.
    """
    fp = fingerprints(docs).select(F.col(id_col).alias("id"), "signatures", "fingerprint")
    classes = written(fp.where(F.size("signatures") > 0).groupBy("fingerprint").agg(F.min("id").alias("class_id"), F.first("signatures").alias("sigs")), "classes")
    members = fp.join(classes.select("fingerprint", "class_id"), "fingerprint", "left").select("id", F.coalesce("class_id", "id").alias("class_id"))
    flat = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = flat.groupBy("sig").count()
    ranked = flat.join(often, "sig").withColumn("r", F.row_number().over(Window.partitionBy("class_id").orderBy("count", "sig")))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
    prefix = prefix.withColumn("part", F.floor(F.log("n") / -F.log(F.lit(threshold)) + 1e-9))
    left = prefix.select("sig", F.col("class_id").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    right = prefix.select("sig", "part", F.col("class_id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    found = left.join(right, ["sig", "part"]).where(fits).select("a", "b").distinct()
    sets = lambda k: classes.select(F.col("class_id").alias(k), F.col("sigs").alias(f"s{k}"))
    scored = found.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return scored.where(F.col("likeness") >= threshold), members
