"""N-gram Jaccard self-join by filters under several global orders, and its connected components.

A document is the set of its word n-grams.  Two sets with Jaccard similarity ``num / den`` or more share a token
among the first few of each *under every order of all tokens*: with ``p = size - ceil(num * size / den) + 1`` the
prefix length, prefixes that do not meet prove that the sets do not either.  Candidates must meet under every order:

* order 1 puts rare tokens first.  A token is at most as frequent as its rarest word, and as the counter of its hash
  says: two count sketches of fixed size over the whole corpus, of words and of n-grams, give both bounds, and the
  lower one counts.  Words are far fewer than n-grams, so theirs still tells rare from frequent where the other is
  long full; the other knows passages of frequent words that many documents share.  Tokens that turn out to be crowded
  all the same (the first prefixes of many documents hold them, which is counted exactly) are put behind all others, and the
  documents that had them in front get new prefixes: the sketches may fill up as the input grows, the order stays good.
  Order 1 makes the candidates, with the size and position filters on top;
* orders 2 and 3 are by two independent hashes; their prefixes are kept as short signatures (equal tokens have equal
  signatures, so no link is lost) and are intersected with the candidates before any set is compared;
* what is left is verified on the whole sets.

Equal sets collapse to their smallest document first, and tokens that exactly the same documents hold, such as those of
a passage, to one.  Then, for each token of order 1, every document meets only the token's leader, the one that holds it nearest to its front: the original of a family of copies, which has the fewest
rare tokens.  The verified links give components.  Documents that share a token but are still in different components
meet in a second pass, at least one of them outside the leader's component.  Tokens that many unlinked documents hold
come last under order 1, and there a document meets only the others of its band of sizes.

Defined results: null text counts as empty; a text with fewer words than n is one n-gram, an empty one has the empty
set and no links; repeated rows get the same result; a null doc_id counts as a document of its own that has no
links and a null component; different texts under one doc_id count as one document that has the links of each, with
the n_shingles of each row; an empty table gives an empty result.  Texts are read whole; extra columns, whatever their
names, are ignored (``drop_near_duplicates`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shipping import ship_package
from .common import drop_rows, pick, split_by_ids, stage, unstage
from .components import components, join_components
from .word_arrays import release

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ORDERS = (np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
_BLOCK = 4096
#: Texts are split so many bytes at a time.
_CHUNK = 1 << 21


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def _word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text, the 64-bit hashes of its words, A-Z in lower case."""
    import xxhash

    texts = pc.fill_null(texts, "")
    size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, size[a] + _CHUNK, "right")) - 1)
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(a, b - a)))
        coded = split.flatten().dictionary_encode()
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        # Outer white space gives empty words, which are none.
        full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        at = coded.indices.to_numpy(zero_copy_only=False)
        real = full[at]
        stops = np.concatenate([[0], np.cumsum(real)])[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]
        yield from np.split(known[at[real]], stops[:-1])
        a = b


def _ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every n-gram of a text of hashed words, or of the whole text where it has fewer words."""
    k = min(n, len(words))
    if not k:
        return words
    h = np.full(len(words) - k + 1, np.uint64(k)) * _M1
    for j in range(k):
        h = _mix(h + words[j : len(words) - k + 1 + j] * _M1)
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z in lower case."""
    return np.unique(_ngrams(next(_word_hashes(pa.array([text], pa.string()))), n))


def _prefix_length(size: int, num: int, den: int) -> int:
    return size - -(-num * size // den) + 1 if size else 0


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def _counts(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Per task, the blocks of its counts of words, and behind them of n-grams: block, task, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(2 << bits, np.uint32)
        for batch in batches:
            for words in _word_hashes(batch.column(0)):
                np.add.at(counts, _slots(words, bits), 1)
                np.add.at(counts, _slots(_ngrams(words, n), bits) + (1 << bits), 1)
        task = TaskContext.get().partitionId()
        for b in range(0, len(counts), _BLOCK):
            part = counts[b : b + _BLOCK]
            if part.any():
                yield pa.record_batch([pa.array([b // _BLOCK], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "task", "counts"])
        release()

    return docs.select("text").mapInArrow(run, "block int, task int, counts binary")


def _sum_blocks(blocks: DataFrame, *keys: str) -> DataFrame:
    """Sum count blocks; a task adds up its rows one after the other and holds only its own blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(data.as_py(), np.uint32)
                sums[b] = sums[b] + part if b in sums else part
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["block", "counts"])

    return blocks.repartition(*keys).select("block", "counts").mapInArrow(run, "block int, counts binary")


def _sketch(docs: DataFrame, n: int, bits: int) -> np.ndarray:
    """The corpus-wide counts: 8 * 2**bits bytes whatever the input; the only thing that reaches the driver."""
    counted = stage(_counts(docs, n, bits), "ngram-counts")
    blocks = counted.select("block", "counts", F.pmod("task", F.lit(64)).alias("lane"))
    # Two levels, so that no task reads the blocks of all tasks.
    lanes = stage(_sum_blocks(blocks, "block", "lane"), "sketch-lanes")
    out = np.zeros(2 << bits, np.uint32)
    for row in _sum_blocks(lanes, "block").collect():
        part = np.frombuffer(row["counts"], np.uint32)
        out[row["block"] * _BLOCK : row["block"] * _BLOCK + len(part)] += part
    unstage(counted, lanes)
    return out


def _marked(tokens: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether the bit of each token is set."""
    slots = tokens & np.uint64(8 * len(marks) - 1)
    return (marks[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _rarest(words: np.ndarray, n: int, counts: np.ndarray, marks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct n-grams in ascending order, their places under order 1: marked ones last, then the lower bound of their
    frequency, then the bound by their words, then hash)."""
    grams = _ngrams(words, n)
    s, first = np.unique(grams, return_index=True)
    if not len(s):
        return s, first
    bits = len(counts).bit_length() - 2
    k, c = min(n, len(words)), counts[_slots(words, bits)]
    by_word = np.minimum.reduce([c[j : len(words) - k + 1 + j] for j in range(k)])[first]
    keys = [s, by_word, np.minimum(by_word, counts[_slots(s, bits) + (1 << bits)])]
    return s, np.lexsort(keys if marks is None else [*keys, _marked(s, marks)])


def _prefixes(docs: DataFrame, n: int, num: int, den: int, counts: np.ndarray, marks: np.ndarray | None = None) -> DataFrame:
    """doc_id, size, set_key, prefix (tokens under order 1) and sig2, sig3 (signatures of the prefixes under orders 2
    and 3)."""
    shared = docs.sparkSession.sparkContext.broadcast((counts, marks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        counts, marks = shared.value
        for batch in batches:
            sizes, keys, firsts, sigs = [], [], [], ([], [])
            for words in _word_hashes(batch.column(1)):
                s, order = _rarest(words, n, counts, marks)
                p = _prefix_length(len(s), num, den)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                firsts.append(s[order[:p]].view(np.int64))
                for out, salt in zip(sigs, _ORDERS):
                    h = _mix(s * salt)
                    out.append((np.partition(h, p - 1)[:p] if 0 < p < len(h) else h[:p]).astype(np.uint16).view(np.int16))
            ends = pa.array(np.cumsum([0] + [len(x) for x in firsts]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *x]))) for x, kind in ((firsts, np.int64), (sigs[0], np.int16), (sigs[1], np.int16))]
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), *lists]
            yield pa.record_batch(columns, ["doc_id", "size", "set_key", "prefix", "sig2", "sig3"])
        release()

    return docs.mapInArrow(run, "doc_id long, size long, set_key binary, prefix array<long>, sig2 array<short>, sig3 array<short>")


def _crowded(prefixes: DataFrame, crowd: int, max_bits: int = 27) -> np.ndarray | None:
    """Bitmap of the tokens that more than ``crowd`` prefixes hold, of at most 2**max_bits / 8 bytes; None where there is none."""
    tokens = prefixes.filter("doc_id is not null").select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("k"))
    tokens = stage(tokens.filter(F.col("k") > crowd).select("token"), "ngram-crowded")
    n = tokens.count()
    bits = min(max_bits, max(15, (16 * n).bit_length()))
    slot = F.pmod("token", F.lit(1 << bits))
    # At most 2**max_bits / 32768 rows of 4 KB.
    blocks = tokens.groupBy(F.floor(slot / 32768).alias("block")).agg(F.bitmap_construct_agg(slot % 32768).alias("bits"))
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect() if n else []:
        marks[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)
    unstage(tokens)
    return marks if n else None


def _reordered(docs: DataFrame, prefixes: DataFrame, n: int, num: int, den: int, counts: np.ndarray, crowd: int) -> DataFrame:
    """``prefixes`` with crowded tokens behind all others.

    A prefix without any stays as it is, as the order of its tokens is unchanged; the others are made anew.
    """
    marks = _crowded(prefixes, crowd)
    if marks is None:
        return prefixes
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            tokens = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            hits = np.concatenate([[0], np.cumsum(_marked(tokens, shared.value))])
            yield pa.record_batch([batch.column(0).filter(pa.array(hits[ends[1:]] > hits[ends[:-1]]))], ["doc_id"])

    again = stage(prefixes.filter("doc_id is not null").select("doc_id", "prefix").mapInArrow(held, "doc_id long").distinct(), "ngram-again")
    # The bitmap of ids parts documents and prefixes alike.
    kept = split_by_ids(prefixes, again)[1].toDF(*prefixes.columns)
    new = _prefixes(split_by_ids(docs, again)[0].toDF(*docs.columns), n, num, den, counts, marks)
    out = stage(kept.unionByName(new), "ngram-prefixes")
    unstage(prefixes, again)
    return out


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, num: int, den: int) -> Column:
    """Size filter, and position filter at a first common token: what may still be shared from there on."""
    n1, n2 = n1.cast("long"), n2.cast("long")
    sized = F.least(n1, n2) * den >= F.greatest(n1, n2) * num
    return sized & (F.least(n1 - p1, n2 - p2) * (num + den) >= (n1 + n2) * num)


def _meet(a2: str, b2: str, a3: str, b3: str) -> Column:
    """Whether prefixes meet under orders 2 and 3, by their signatures."""
    return F.arrays_overlap(a2, b2) & F.arrays_overlap(a3, b3)


def _verify(docs: DataFrame, sigs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of ``pairs`` (a, b) those that meet under orders 2 and 3 and whose whole sets are similar enough.

    Neither texts nor signatures of other documents are shuffled: only those of the pairs' documents pass where they
    are read.
    """
    named = lambda rows: stage(rows.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ngram-named")
    in_pairs = named(pairs)
    few = split_by_ids(sigs.select("doc_id", "sig2", "sig3"), in_pairs)[0].toDF("doc_id", "sig2", "sig3")
    few = stage(few, "ngram-signatures")
    side = lambda who: few.select(F.col("doc_id").alias(who), F.col("sig2").alias(f"{who}2"), F.col("sig3").alias(f"{who}3")).hint("merge")

    with_sigs = pairs.join(side("a"), "a").join(side("b"), "b").filter(_meet("a2", "b2", "a3", "b3"))
    left = stage(with_sigs.select("a", "b").distinct(), "ngram-candidates")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.unique(_ngrams(words, n)).tobytes() for words in _word_hashes(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "tokens"])
        release()

    wanted = named(left)
    texts = split_by_ids(docs.select("doc_id", "text"), wanted)[0].toDF("doc_id", "text")
    whole = stage(texts.mapInArrow(sets, "doc_id long, tokens binary").distinct(), "ngram-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * den >= (len(x) + len(y) - both) * num)
            yield pa.record_batch([pa.array([v for v, k in zip(side, good) if k], pa.int64()) for side in (a, b)], ["a", "b"])

    one = lambda who: whole.select(F.col("doc_id").alias(who), F.col("tokens").alias(f"{who}t")).hint("merge")
    out = left.join(one("b"), "b").join(one("a"), "a").select("a", "b", "at", "bt").mapInArrow(check, "a long, b long").distinct()
    out = stage(out, "ngram-links")
    unstage(in_pairs, few, left, wanted, whole)
    return out


def _second_pass(shared: DataFrame, leads: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of documents that share a token of order 1, lie in different components of ``found``, at least one
    outside the component of the token's leader, and pass the size and position filters."""
    comp = found.withColumnRenamed("node", "doc_id").withColumnRenamed("component", "comp")
    heads = leads.select("token", F.col("lead.doc_id").alias("doc_id")).join(comp.hint("merge"), "doc_id", "left")
    heads = stage(heads.select("token", F.coalesce("comp", "doc_id").alias("major")), "ngram-heads")
    rows = shared.join(comp.hint("merge"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")).join(heads.hint("merge"), "token")
    # Sizes of similar sets lie in one band or in neighbours.
    rows = rows.withColumn("band", F.floor(F.log(F.col("size")) / math.log(den / num)).cast("int"))
    rows = stage(rows, "ngram-spread")
    names = ["doc_id", "size", "pos", "comp"]
    other = rows.filter("comp != major").select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), *[F.col(c).alias(f"{c}_m") for c in names])
    rest = rows.join(
        other.hint("merge"),
        (rows["token"] == other["token"]) & (rows["band"] == other["band"]) & (F.col("comp") != F.col("comp_m"))
        & ((F.col("comp") == F.col("major")) | (F.col("doc_id") < F.col("doc_id_m")))
        & _may_link(F.col("size"), F.col("pos"), F.col("size_m"), F.col("pos_m"), num, den),
    )
    rest = stage(rest.select(F.least("doc_id", "doc_id_m").alias("a"), F.greatest("doc_id", "doc_id_m").alias("b")).distinct(), "ngram-rest")
    unstage(rows, heads)
    return rest


def ngram_components(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10, sketch_bits: int = 19, crowd: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id in reach).

    Documents link where ``den * |both| >= num * |either|``.  ``sketch_bits`` sizes the count sketch, and tokens that more than
    ``crowd`` prefixes hold go to the end; both decide only how well rare tokens are told from frequent ones, never which
    links are found.
    """
    ship_package(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    counts = _sketch(docs, n, sketch_bits)
    prefixes = _reordered(docs, stage(_prefixes(docs, n, num, den, counts), "ngram-prefixes"), n, num, den, counts, crowd)
    members = prefixes.select("doc_id", "size", "set_key")
    named = members.filter("size > 0 and doc_id is not null")
    reps = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size")), "ngram-reps")
    # Sets of this size link to no different set: one token more or less is too much already.
    least = den // (den - num) - 1
    able = reps.filter(F.col("size") >= least).select("set_key", F.col("rep").alias("doc_id"))
    rows = prefixes.select("doc_id", "size", "set_key", "prefix").join(able.hint("merge"), ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"])
    postings = stage(rows.select("doc_id", F.col("size").cast("int").alias("size"), F.posexplode("prefix").alias("pos", "token")), "ngram-postings")

    # Tokens of the same holders make the same candidates; one name for all of them, by a sum over the holders (should
    # two sets of holders ever have one sum, their documents meet as well: more candidates, none lost).
    holders = F.sum(F.xxhash64("doc_id").cast("decimal(20,0)"))
    tokens = postings.groupBy("token").agg(F.count("*").alias("k"), holders.alias("holders")).filter("k > 1")
    tokens = stage(tokens.select("token", F.xxhash64("k", "holders").alias("holders")), "ngram-tokens")
    shared = postings.join(tokens.hint("merge"), "token").groupBy(F.col("holders").alias("token"), "doc_id").agg(F.min("pos").alias("pos"), F.first("size").alias("size"))
    shared = stage(shared, "ngram-shared")
    unstage(postings, tokens)
    leads = stage(shared.groupBy("token").agg(F.min(F.struct("pos", "size", "doc_id")).alias("lead")), "ngram-leads")
    size, pos, lead = F.col("size"), F.col("pos"), F.col("lead")
    stars = shared.join(leads.hint("merge"), "token").filter((F.col("doc_id") != lead["doc_id"]) & _may_link(size, pos, lead["size"], lead["pos"], num, den))
    stars = stars.select(lead["doc_id"].alias("a"), F.col("doc_id").alias("b"))
    pairs = stage(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "ngram-stars")
    links = _verify(docs, prefixes, pairs, n, num, den)
    found = stage(components(links), "ngram-components")

    rest = _second_pass(shared, leads, found, num, den)
    rest = rest.join(pairs, ["a", "b"], "left_anti")
    more = _verify(docs, prefixes, rest, n, num, den)
    final = join_components(found, more)
    unstage(shared, leads)

    # Empty sets have no key; they take no part in the join, however many there are.
    out = members.filter("set_key is not null").join(reps.select("set_key", "rep"), "set_key", "left").join(final, F.col("rep") == F.col("node"), "left")
    out = out.select("doc_id", "size", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    out = out.unionByName(members.filter("set_key is null").select("doc_id", "size", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns unchanged.

    Rows without a doc_id stay, as do repeated rows of a doc_id that stays; an empty table stays empty.
    """
    found = ngram_components(docs, **options)
    return drop_rows(docs, found.filter(F.col("component_id") != F.col("doc_id")).select("doc_id"))
