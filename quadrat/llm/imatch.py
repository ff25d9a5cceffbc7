"""I-Match document fingerprints, in DataFrame operations only.

Terms whose inverse document frequency lies in a band form the lexicon. A fingerprint has one digest for
the lexicon and one for each of several randomised subsets of it: the hash of the sorted distinct terms
that the document has in the subset. A change outside a subset leaves that digest as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, cut, following

#: The band, as shares of all documents that hold a term: idf = ln(1 / share) from 2.3 to 6.9.
RARE, COMMON = 0.001, 0.1
#: Share of the lexicon in each subset, in 256ths; the first digest is of the whole lexicon.
SUBSETS = (256, 128, 64, *[32] * 2, *[16] * 3, *[8] * 8, *[4] * 8)
SPACE = "[ \t-\r]+"
#: Terms that may be broadcast, two numbers each. The band bounds the lexicon by the mean number of
#: distinct terms of a document divided by RARE, whatever the number of documents; more are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Digests, of 16 hexadecimal digits (64 bits) each, follow each other in a fingerprint; none of the subset's terms: zeros.
DIGEST, NONE = 16, "0" * 16


def words(text: Column) -> Column:
    """The distinct lower-case words between ASCII white space, and maybe one empty word."""
    return F.array_distinct(F.split(F.lower(text), SPACE))


def lexicon(docs: DataFrame, text_col: str = "text", rare: float = RARE, common: float = COMMON) -> DataFrame:
    """(hash, term): the terms of the band by their XXH64, and the number that stands for each.

    A term's number has 39 bits of its SHA-256 over one bit for each subset, which tells whether that has
    the term (the first subset has all). Numbers are the same in every lexicon, and their order is the order
    of terms. The empty word is there too, as number 0, so that every text holds some term. Document
    frequencies are over all rows and summed before they are shuffled. A term in one document only is never
    kept. Words are told apart by 64 bits.
    """
    n = docs.count()
    counted = docs.select(F.explode(words(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).filter("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    kept = counted.filter(F.col("df").between(max(2.0, rare * n), max(2.0, common * n)))
    digest = F.sha2(F.concat(F.lit("i-match:"), "term"), 256)
    number = F.shiftleft(F.shiftright(F.conv(F.substring(digest, 49, 10), 16, 10).cast("long"), 1), len(SUBSETS)) + F.lit(1)
    for k, share in enumerate(SUBSETS[1:], 1):
        # two hexadecimal digits of the term's digest, others for each subset
        number = number + F.when(F.conv(F.substring(digest, 2 * k, 2), 16, 10).cast("int") < share, 1 << k).otherwise(0)
    none = docs.sparkSession.createDataFrame([("", 0)], "term string, number long")
    return kept.select("term", number.alias("number")).unionByName(none).select(F.xxhash64("term").alias("hash"), F.col("number").alias("term"))


def digests(texts: DataFrame, terms: DataFrame, keys: list[str], text_col: str, broadcast: bool, carried: list[str] | None = None) -> DataFrame:
    """keys, fingerprint (binary) and the carried columns for each row of texts, which keys name; without a term of a subset its digest is zero.

    Where texts is partitioned by some of the keys, a row's terms meet without another shuffle. Carried
    columns go with the empty word alone, so the many rows of terms are a few numbers each.
    """
    carried = carried or []
    every = F.concat(F.split(F.lower(F.col(text_col)), SPACE), F.array(F.lit("")))
    found = texts.select(*keys, *carried, F.explode(every).alias("word")).withColumn("hash", F.xxhash64("word"))
    found = found.join(F.broadcast(terms) if broadcast else terms, "hash")
    load = [F.struct(*carried)] if carried else []
    found = found.select(*keys, F.when(F.col("term") != 0, F.col("term")).alias("held"), *(F.when(F.col("term") == 0, x).alias("load") for x in load))
    listed = found.groupBy(*keys).agg(F.collect_list("held").alias("held"), *(F.first("load", ignorenulls=True).alias("load") for _ in load))
    columns = [*keys, *(F.col(f"load.{c}").alias(c) for c in carried)]
    names = [*keys, *carried]
    listed = listed.select(*columns, F.sort_array(F.array_distinct("held")).alias("held"))
    # a subset is looked for among the terms that any subset of its size has: few of all
    level = {share: sum(1 << k for k, x in enumerate(SUBSETS) if x == share) for share in SUBSETS}
    parts = listed.select(*names, *(_in("held", bits).alias(f"of{share}") for share, bits in level.items()))
    lists = parts.select(*names, *(F.concat_ws(" ", (F.col(f"of{x}") if level[x] == 1 << k else _in(f"of{x}", 1 << k)).cast("array<string>")).alias(f"s{k}") for k, x in enumerate(SUBSETS)))
    zero = F.unhex(F.lit(NONE))
    return lists.select(*names, F.concat(*(F.when(F.col(f"s{k}") == "", zero).otherwise(_own(F.col(f"s{k}"))) for k in range(len(SUBSETS)))).alias("fingerprint"))


def _in(column: str, bits: int) -> Column:
    """The held terms that any subset of these bits has; the first subset has all."""
    return F.col(column) if bits == 1 else F.filter(column, lambda x: x.bitwiseAND(F.lit(bits)) != 0)


def _own(text: Column) -> Column:
    """The digest of a text, as eight bytes."""
    return F.unhex(F.substring(F.md5(text), 1, DIGEST))


def _filled(fingerprint: Column, digest: Column) -> Column:
    """A fingerprint without any term of the lexicon has the text's own digest in every place."""
    return F.when(fingerprint == F.unhex(F.lit(NONE * len(SUBSETS))), F.concat(*[digest] * len(SUBSETS))).otherwise(fingerprint)


def _text(fingerprint: Column) -> Column:
    return F.lower(F.hex(fingerprint))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal digests among those that either (binary) fingerprint has; 1 for equal fingerprints."""
    equal = either = F.lit(0)
    zero = F.unhex(F.lit(NONE))
    for k in range(len(SUBSETS)):
        x, y = (F.substring(c, 1 + k * DIGEST // 2, DIGEST // 2) for c in (a, b))
        some = (x != zero) | (y != zero)
        either = either + F.when(some, 1).otherwise(0)
        equal = equal + F.when(some & (x == y), 1).otherwise(0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(equal.cast("double"), either.cast("double")), F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every distinct (id, text) of docs; a null text counts as empty."""
    terms = cut(lexicon(docs, text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).repartition("id")
    rows = rows.select("id", "body", F.sha2("body", 256).alias("sha"), _own(F.col("body")).alias("own"))
    found = digests(rows.dropDuplicates(["id", "sha"]), terms, ["id", "sha", "own"], "body", terms.count() <= BROADCAST_TERMS)
    return found.select("id", _text(_filled(F.col("fingerprint"), F.col("own"))).alias("fingerprint"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint beside those of its edited text and of the next document.

    The next document has the next smaller id, the largest after the smallest; of rows that share an id
    it is the one with the smallest SHA-256. A null id stands for the smallest bigint, which itself reads
    as null, and a null text is empty. The edited text has its last floor(n_chars / 2) code points replaced
    by the first as many of the next document's, or all if it is shorter. Repeated rows stay repeated. An
    empty table gives no rows. The lexicon is of docs.

    Texts are shuffled once whole, by id (both joins read that shuffle), and once as the heads that edits
    need. What a row needs later travels with one of its terms, so fingerprints need no shuffle.
    """
    terms = cut(lexicon(docs, text_col))
    small = terms.count() <= BROADCAST_TERMS
    raw = docs.select(F.coalesce(F.col(id_col), F.lit(NULL_ID)).cast("long").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    sizes = cut(raw.groupBy("key").agg(F.max(F.char_length("body")).alias("chars"), F.min(F.sha2("body", 256)).alias("first_sha")))
    order = following(sizes.select("key"))
    wanted = order.join(sizes.select("key", "chars"), "key").select(F.col("next_key").alias("from_key"), F.col("key").alias("to_key"), F.floor(F.col("chars") / 2).cast("int").alias("need"))
    wanted = cut(wanted.join(sizes.select(F.col("key").alias("from_key"), "first_sha"), "from_key"))
    rows = raw.repartition("key").groupBy("key", "body").agg(F.count("*").alias("n")).withColumn("sha", F.sha2("body", 256))
    # equal digests as a condition on the joined row: as a join key they would shuffle the texts again
    first = F.least("sha", "first_sha") == F.greatest("sha", "first_sha")
    heads = rows.filter("n > 0").join(wanted, F.col("key") == F.col("from_key")).filter(first)
    heads = heads.select("to_key", F.col("from_key").alias("next_key"), F.col("sha").alias("next_sha"), F.substring(F.col("body"), F.lit(1), F.col("need")).alias("head"))
    chars = F.char_length("body")
    half = F.floor(chars / 2).cast("int")
    pairs = rows.filter("n > 0").join(heads, F.col("key") == F.col("to_key"))
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), chars - half), F.substring(F.col("head"), F.lit(1), half)))
    carried = ["sha", "n", "n_chars", "next_key", "next_sha", "edited_sha256", "own", "edited_own"]
    pairs = pairs.select("key", "sha", "n", chars.cast("long").alias("n_chars"), "next_key", "next_sha", F.sha2("edited", 256).alias("edited_sha256"), _own(F.col("body")).alias("own"), _own(F.col("edited")).alias("edited_own"), "body", "edited")
    both = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t"))))
    texts = pairs.select("key", *carried, both.alias("x")).select("key", *carried, "x.kind", "x.t").withColumn("own_key", F.xxhash64("sha", "kind"))
    found = digests(texts, terms, ["own_key", "key", "kind"], "t", small, carried)
    prints = [F.max(F.when(F.col("kind") == k, F.col("fingerprint"))).alias(c) for k, c in enumerate(("fingerprint", "edited_fingerprint"))]
    held = found.groupBy("key", *carried).agg(*prints)
    done = cut(held.withColumn("fingerprint", _filled(F.col("fingerprint"), F.col("own"))).withColumn("edited_fingerprint", _filled(F.col("edited_fingerprint"), F.col("edited_own"))).drop("own", "edited_own"))
    others = done.select(F.col("key").alias("k"), F.col("sha").alias("s"), F.col("fingerprint").alias("next_fp"))
    out = done.join(others, (F.col("next_key") == F.col("k")) & (F.col("next_sha") == F.col("s")))
    return out.select(
        F.when(F.col("key") != NULL_ID, F.col("key")).alias("id"),
        "n_chars",
        "edited_sha256",
        _text(F.col("fingerprint")).alias("fingerprint"),
        _text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
        F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"),
    ).drop("copy")
