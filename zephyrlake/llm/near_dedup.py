"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Signature. Each shingle is hashed to 64 bits and mixed by one permutation (sigma, bijective): the top 20 bits are
its bin, the others its order in the bin, of which the least counts. A second
permutation (pi, a table over bins) is shifted circularly by k to give coordinate k of the signature: the bin that is
first by pi[(bin + k) mod D], with the least order in it. All coordinates of a bin are thus
one contiguous slice of pi, and sets of more shingles than there are bins are told apart by the orders.

Candidates. Bands of `rows` coordinates; their number follows from the threshold so that a
pair at the threshold is missed with a chance under `miss`. Rows with equal word sequences
are one class before banding, so exact copies never meet in a bucket. Classes are keyed by a 128-bit digest of their words, and
by a number made from it that is checked to be unique: ids may repeat with other texts.

Verification, without all pairs of a bucket:
1. Star: every member of a bucket is compared with the bucket's smallest class on full
   shingle sets; confirmed links give components.
2. Blocks: in a bucket that still spans several components, the members outside its commonest component are compared
   with each other and with that component, block by block: a block is bounded in rows and in shingles, and a task counts common
   shingles of two blocks through an index; pairs already in one component are skipped. Only one link per
   member and component leaves the task. No bucket is capped: larger ones make more block pairs. Members of the commonest
   component are sent once for each block of others, so a bucket of near copies with few others costs in proportion to its size.
   Buckets with the same members count once.

Shingle sets are sets of 64-bit hashes (a wrong set size needs a collision inside one pair).

Defined results: null and empty texts, and texts of white space, have an empty set, are
linked with nothing and are their own component; a text with fewer words than a shingle has
its whole sequence as one shingle; repeated rows and equal texts are one class; of rows that share an id, each is judged by its own text;
a null id is kept as it is and is the smallest only where all are null; an empty table gives no rows; a very long text
counts whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zephyrlake.llm.common import ASCII_LOWER, Scratch, in_small_batches, read, releasing, slot_of, split_by_slots

UNIVERSE_BITS = 20
#: The hashes' odd multipliers; any odd 64-bit numbers do.
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class NearDup:
    """Words to a shingle, threshold as a fraction num/den, rows of a band, chance of a miss, shingles and rows in a block."""

    words: int = 5
    num: int = 80
    den: int = 100
    rows: int = 5
    miss: float = 1e-7
    block: int = 1_500_000
    block_rows: int = 256
    seed: int = 11

    @property
    def bands(self) -> int:
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - (self.num / self.den) ** self.rows)))

    def linked(self, common, n, m):
        return (common > 0) & (self.den * common >= self.num * (n + m - common))


#: Word characters: all bytes but \x20 and \x09-\x0D. A 64-bit value for each byte.
IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
BYTE = np.random.default_rng(5).integers(0, 2**64, 256, np.uint64)
PIECE = 1 << 18


@lru_cache(maxsize=1)
def _piece_powers(n: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n or PIECE + 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M1**i and its inverse for i under n."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, m, np.uint64)])) for m in (M1, np.uint64(pow(int(M1), -1, 1 << 64))))


def _hashes(b: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = IS_WORD[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = _piece_powers() if len(b) <= PIECE else _powers(len(b) + 1)  # only a single word can be longer
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE[b] * up[: len(b)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | bytes | None) -> np.ndarray:
    """A 64-bit polynomial hash of each word [^\\x20\\x09-\\x0D]+, A-Z lower-cased, in the text's order."""
    data = text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data.translate(ASCII_LOWER), np.uint8)
    if len(b) <= PIECE:
        return _hashes(b)
    gaps, out, at = np.flatnonzero(~IS_WORD[b]), [], 0
    while at < len(b):  # pieces of about PIECE bytes that end at white space
        k = np.searchsorted(gaps, at + PIECE, "right") - 1
        k = k if k >= 0 and gaps[k] > at else np.searchsorted(gaps, at + PIECE)
        to = int(gaps[k]) + 1 if k < len(gaps) else len(b)
        out.append(_hashes(b[at:to]))
        at = to
    return np.concatenate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * M2
    h = (h ^ (h >> np.uint64(29))) * M1
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of word hashes; all words as one where there are fewer."""
    if not len(h):
        return np.empty(0, np.uint64)
    k = min(k, len(h))
    n = len(h) - k + 1
    out = h[:n]
    for i in range(1, k):
        out = mix(out) + h[i : i + n]
    out = np.sort(mix(out + np.uint64(k)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Signer:
    """sigma and pi; band keys of a set."""

    def __init__(self, cfg: NearDup):
        self.cfg, self.n, self.size = cfg, cfg.bands * cfg.rows, 1 << UNIVERSE_BITS
        pi = np.random.default_rng(cfg.seed).permutation(self.size).astype(np.int32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: self.n]]), self.n)
        self.back = np.empty(self.size, np.int32)
        self.back[pi] = np.arange(self.size, dtype=np.int32)
        self.mult = np.random.default_rng(cfg.seed + 1).integers(1, 2**63, (cfg.bands, cfg.rows), np.int64).astype(np.uint64) | np.uint64(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        order = np.sort(mix(s * M1))
        at = (order >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        first = np.concatenate([[True], at[1:] != at[:-1]])  # of a bin, the least order
        at, order = at[first], order[first]
        sig = self.slices[at[:2048]].min(0)
        for i in range(2048, len(at), 2048):
            np.minimum(sig, self.slices[at[i : i + 2048]].min(0), out=sig)
        bins = (self.back[sig] - np.arange(self.n)) % self.size
        return order[np.searchsorted(at, bins)]  # bin and order in one number

    def bands(self, s: np.ndarray) -> np.ndarray:
        sig = self.signature(s).reshape(self.cfg.bands, self.cfg.rows)
        keys = mix((sig * self.mult).sum(1) + np.arange(self.cfg.bands, dtype=np.uint64) * M1)
        return keys.view(np.int64)


def _sign(cfg: NearDup):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        signer = Signer(cfg)
        for b in batches:
            n, digest, bands = [], [], []
            for text in b.text:
                words = word_hashes(text)
                s = shingles(words, cfg.words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(words.tobytes()) if len(s) else None)
                bands.append(signer.bands(s) if len(s) else None)
            yield pd.DataFrame({"id": b.id, "version": b.version, "n": n, "digest": digest, "bands": bands})

    return run


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts as zstd: they are shuffled several times."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for b in batches:
        yield pd.DataFrame({"id": b.id, "version": b.version, "text": [pack((t or "").encode("utf-8", "surrogatepass")) for t in b.text]})


def _unpack(b: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(bytes(b))


def _verify(cfg: NearDup):
    """Pairs (a, b, text_a, text_b) to those that are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for p in batches:
            keep = []
            for a, x, y in zip(p.a, p.text_a, p.text_b, strict=True):
                if a != last:
                    last, left = a, shingles(word_hashes(_unpack(x)), cfg.words)
                right = shingles(word_hashes(_unpack(y)), cfg.words)
                keep.append(bool(cfg.linked(len(np.intersect1d(left, right, assume_unique=True)), len(left), len(right))))
            yield p.loc[keep, ["a", "b"]]

    return run


def _block_links(cfg: NearDup):
    """Block i against block j of one bucket: for each row of i, one link into each other component it reaches."""

    def run(key: tuple, left: pd.DataFrame) -> pd.DataFrame:
        *_, i, j = key
        rows = left[left.block == j]
        asks = rows if i == j else left[left.block == i]
        sets = [shingles(word_hashes(_unpack(t)), cfg.words) for t in rows.text]
        sizes = np.array([len(s) for s in sets], np.int64)
        flat, owner = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        comp = rows.comp.to_numpy()
        out = []
        for c, text in zip(asks.comp, asks.text, strict=True):
            if not (comp != c).any():
                continue
            s = shingles(word_hashes(_unpack(text)), cfg.words)
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            hits = hi - lo
            if not hits.any():
                continue
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hits)[:-1]]), hits) + np.arange(hits.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            ok = cfg.linked(common, len(s), sizes) & (comp != c)
            out += [(min(c, d), max(c, d)) for d in set(comp[ok])]
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, c): for each end v of an edge (a, b) the smallest vertex it reaches. Min labels with pointer jumping."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = scratch.write(both.distinct(), f"{name}-edges")
    labels = scratch.write(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("c")), f"{name}-0")
    step, done = 0, labels.isEmpty()
    while not done:
        near = edges.join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").groupBy(F.col("a").alias("v")).agg(F.min("cb").alias("near"))
        hook = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        jump = hook.join(labels.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", "was", F.least("c", "up").alias("c"))
        step += 1
        moved = scratch.write(jump, f"{name}-{step}")
        done = moved.filter("c <> was").isEmpty()
        scratch.drop(f"{name}-{step - 1}")
        labels = moved.select("v", "c")
    scratch.drop(f"{name}-edges")
    return labels


def class_number(digest, salt: int):
    """A number for a digest; another one for each salt."""
    return F.xxhash64(digest, F.lit(salt))


def numbered(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """classes with a column class: numbers of their digests, drawn anew where two digests have one."""
    made, salt = scratch.write(classes.withColumn("class", class_number(F.col("digest"), 0)), "classes-0"), 0
    while True:
        twice = made.groupBy("class").agg(F.count("*").alias("of")).filter("of > 1").select("class", F.lit(True).alias("twice"))
        if twice.isEmpty():
            return made
        salt += 1
        again = made.join(twice.hint("merge"), "class", "left")
        again = again.withColumn("class", F.when(F.col("twice"), class_number(F.col("digest"), salt)).otherwise(F.col("class"))).drop("twice")
        made = scratch.write(again, f"classes-{salt}")
        scratch.drop(f"classes-{salt - 1}")


def _open(member: DataFrame, first: DataFrame) -> DataFrame:
    """(bucket, class, comp): members of the buckets of three or more that the stars leave spanning components; of buckets with the same members one."""
    labelled = member.join(first.withColumnRenamed("v", "class"), "class", "left").select("bucket", "class", F.coalesce("c", "class").alias("comp"))
    same = [F.sum(F.xxhash64("class", F.lit(k)).cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)]
    spans = labelled.groupBy("bucket").agg(
        F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("class").alias("a"), F.max("class").alias("z"),
        *same
    )
    spans = spans.filter("m > 2 and lo < hi").groupBy("m", "a", "z", "s1", "s2").agg(F.min("bucket").alias("bucket"))
    return labelled.join(spans.select("bucket"), "bucket")


def _blocks(rows: DataFrame, cfg: NearDup, scratch: Scratch) -> DataFrame:
    """(bucket, i, j, block, class, comp): the block pairs of each bucket; rows has bucket, class, comp, n (shingles)."""
    by_comp = rows.groupBy("bucket", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.greatest(F.ceil(m / cfg.block_rows), F.ceil(n / cfg.block)).cast("int")
    totals = by_comp.groupBy("bucket").agg(F.sum("m").alias("m"), F.sum("n").alias("n"), F.max(F.struct("m", F.bitwise_not("comp").alias("c"), "n")).alias("most"))
    totals = totals.select(
        "bucket", F.bitwise_not("most.c").alias("base"), blocks(F.col("m") - F.col("most.m"), F.col("n") - F.col("most.n")).alias("others"),
        blocks(F.col("most.m"), F.col("most.n")).alias("own")
    )
    totals = scratch.write(totals, "totals")  # written, so that Spark can split a large bucket where the two are joined
    dealt = rows.join(totals.hint("merge"), "bucket").withColumn("is_base", F.col("comp") == F.col("base"))
    block = F.when(F.col("is_base"), F.col("others") + F.pmod(F.xxhash64("class"), F.col("own"))).otherwise(F.pmod(F.xxhash64("class"), F.col("others")))
    last = F.when(F.col("is_base"), F.col("others")).otherwise(F.col("others") + F.col("own")) - 1
    dealt = dealt.select("bucket", "class", "comp", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), last)).alias("with"))
    return dealt.select("bucket", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "class", "comp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: NearDup | None = None) -> DataFrame:
    """id, n_shingles, class_id, component_id for each row: class_id is the smallest id of equal word sequences, component_id the smallest that links reach."""
    cfg, spark = cfg or NearDup(), docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version"),
        F.col(text_col).cast("string").alias("text")
    )
    kind = "id long, version long, n long, digest binary, bands array<long>"
    signed = scratch.write(in_small_batches(docs).mapInPandas(releasing(_sign(cfg)), kind), "signed")

    # least: the smallest id; one: a row that has the class's text
    classes = signed.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("least"), F.min(F.struct("id", "version")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    classes = numbered(classes, scratch)
    # a bucket is a band's key; one member has nothing to be compared with
    member = classes.select(F.explode("bands").alias("bucket"), "class")
    met = member.groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("other")).filter("hub < other").select("bucket", "hub")
    member = scratch.write(member.join(met, "bucket"), "member")
    pairs = scratch.write(member.filter("hub < class").select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), "pairs")

    ends = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    ends = scratch.write(ends.join(classes.select("class", "least", "one", "n").hint("merge"), "class"), "ends")
    # of the texts only those are packed and shuffled whose residue belongs to an end of a pair
    may, _ = split_by_slots(docs, slot_of("id", "version"), ends.select(slot_of("one.id", "one.version")))
    packed = may.mapInPandas(releasing(_pack), "id long, version long, text binary").alias("p")
    held = ends.alias("e").hint("merge")
    texts = packed.join(held, F.col("p.id").eqNullSafe(F.col("e.one.id")) & (F.col("p.version") == F.col("e.one.version"))).select("class", "text")
    texts = scratch.write(texts.dropDuplicates(["class"]), "texts")
    sides = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    sides = sides.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    stars = scratch.write(sides.select("a", "b", "text_a", "text_b").mapInPandas(releasing(_verify(cfg)), "a long, b long"), "stars")
    first = components(stars, scratch, "first")

    left = scratch.write(_open(member, first).join(ends.select("class", "n"), "class"), "open")
    dealt = _blocks(left, cfg, scratch).join(texts.hint("merge"), "class")
    links = dealt.select("bucket", "i", "j", "block", "comp", "text").groupBy("bucket", "i", "j").applyInPandas(_block_links(cfg), "a long, b long")
    links = scratch.write(links.distinct(), "links")
    second = components(links, scratch, "second")

    second = second.select(F.col("v").alias("comp"), F.col("c").alias("top"))
    final = ends.join(first.select(F.col("v").alias("class"), "c"), "class", "left").select("class", "least", F.coalesce("c", "class").alias("comp"))
    final = scratch.write(final.join(second, "comp", "left").select("class", "least", F.coalesce("top", "comp").alias("comp")), "final")
    smallest = final.groupBy("comp").agg(F.min("least").alias("component"))
    final = final.join(smallest, "comp").select("class", "component")
    final = classes.select("digest", "class", "least").join(final, "class", "left").select(
        "digest", "least", F.coalesce("component", "least").alias("component")
    )
    final = scratch.write(signed.select("id", "n", "digest").join(final, "digest", "left"), "result")
    for name in ("signed", "member", "pairs", "ends", "texts", "stars", "open", "totals", "links", "final"):
        scratch.drop(name)
    return final.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("class_id"),
        F.coalesce("component", "id").alias("component_id")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), cfg=NearDup(words=3, num=85, den=100))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "class_id")


#: Exact shingle sets of all pairs of documents that share one, and what links reach.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i+1] || ' ' || w[i+2] for i in range(1, len(w) - 1)] END) AS s
  FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept,
  CASE WHEN len(w) > 0 THEN min(w.doc_id) OVER (PARTITION BY w) ELSE w.doc_id END AS class_id
FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""
