"""N-gram Jaccard join (operator 10): every link between texts of similar shingle sets, by token-combination prefixes.

A document's tokens are its distinct five-word shingles. All tokens share one global order: rare ones
first, frequent ones last, each class by hash. A prefix is as long as it must be for two linked sets
to meet in it. Rare tokens are indexed singly. Frequent tokens are dealt into sub-classes, and pairs
of tokens of one sub-class are indexed; n tokens of a sub-class cover n - 1 differences, so prefixes
extend until what they cover exceeds the differences that a link allows. The number of sub-classes
follows the set size, and a set near a boundary is indexed for both sides of it. Candidates are then
verified on the whole sets.

Texts are hashed once. Of each set its head is written: its smallest tokens, an eighth of the set more
than a prefix of rare tokens needs. Frequencies are counted on the heads of distinct texts and prefixes
are taken from them; only a set whose head holds too few rare tokens is made again from its text, and
the rest of its tokens is counted, too. Which tokens count as frequent changes the work, never a link.

Index entries travel as compressed blocks, one per map task and shard. A bucket of up to
``PAIR_BUCKET`` sets gives its pairs. A larger one gives a star round its smallest member; once the
stars are verified and joined into components, only those members that are still apart meet each
other, so that a group of thousands of copies costs a multiple of its size and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BITMAP, arrow_batches, bitmaps, cut, few, filter_bits, schema, split_by_ids, table, without
from .components import components
from .hashing import mix, shingle_sets, steps

#: Frequencies are counted by the upper 40 bits of a token.
SHORT = np.uint64(24)
#: A token in more documents than this is of the frequent class.
FREQUENT = 32
#: Bits of the class filter for each frequent token.
CLASS_BITS = 16
#: Tokens in heads for each shard of counts and index entries.
SHARD_TOKENS = 2_000_000
#: Buckets up to this size give all their pairs, larger ones a star.
PAIR_BUCKET = 12
#: Sets below this size are indexed by single tokens only.
SMALL_SET = 64
#: Members of large buckets that meet in one task, and cells of a table of their pairs at once.
GROUP_MEMBERS, CELLS = 100_000, 200_000
#: Rounds of stars in large buckets before all pairs that are still apart meet; none while those are at most so many a member.
ROUNDS, EASY = 2, 200
#: Index entries that a map task holds before it sends a block to each shard.
BLOCK_ENTRIES = 2_000_000


def pack(x: np.ndarray, width: int = 8) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(x.astype(f"<u{width}")).view(np.uint8).reshape(-1, width).T
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpack(data: bytes, n: int, width: int = 8) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * width, asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def text_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
    for a, b, raw, offsets in steps(batch.column("text")):
        yield from zip(ids[a:b].tolist(), shingle_sets(raw, offsets, size), strict=True)


def ends_of(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sets end to end, and where each begins (n + 1 entries)."""
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)]


def fingerprints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two independent 64-bit sums of each set's tokens."""
    tokens, first = ends_of(sets)
    out = []
    for salt in (0, 0xA5A5A5A5A5A5A5A5):
        total = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)), dtype=np.uint64)]
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


def parities(sets: list[np.ndarray], bits: np.ndarray) -> list[bytes]:
    """For each set as many bits as asked for (a power of two from 8 up); each says whether an odd number of tokens falls on it, so two sets differ in at least as many tokens as bits."""
    tokens, first = ends_of(sets)
    at = np.r_[0, np.cumsum(bits)]
    row = np.repeat(np.arange(len(sets)), np.diff(first))
    odd = np.bincount(at[row] + (tokens.view(np.int64) & (bits - 1)[row]), minlength=at[-1]).astype(np.uint8) & 1
    flat = np.packbits(odd).tobytes()
    return [flat[a:b] for a, b in zip((at[:-1] // 8).tolist(), (at[1:] // 8).tolist(), strict=True)]


def wide_bits(sizes: list[int]) -> np.ndarray:
    """About four bits for each token, a power of two of bits."""
    return np.array([1 << max(9, (4 * n).bit_length()) for n in sizes], np.int64)


PARITY = [f"p{i}" for i in range(8)]
PRINTS = "doc_id long, n_shingles long, fp1 long, fp2 long, " + ", ".join(f"{p} long" for p in PARITY)


def needed(n, percent: int):
    """How many tokens of a set of n make a prefix."""
    return n - -(-percent * n // 100) + 1


def head_length(n: int, percent: int) -> int:
    return min(n, needed(n, percent) + n // 8 + 8)


def sizes_and_prints(size: int, percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, sets = zip(*text_sets(batch, size), strict=True)
                n = [len(s) for s in sets]
                narrow = np.frombuffer(b"".join(parities(sets, np.full(len(n), 512))), np.int64).reshape(-1, len(PARITY))
                heads = [s[: head_length(len(s), percent)].astype("<u8").tobytes() for s in sets]
                numbers = [ids, n, *fingerprints(sets), *narrow.T]
                columns = [*(pa.array(np.ascontiguousarray(x), pa.int64()) for x in numbers), pa.array(parities(sets, wide_bits(n)), pa.binary()), pa.array(heads, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "fp1", "fp2", *PARITY, "parity", "head"])

    return run


def close(x: str, y: str, percent: int) -> Column:
    """Whether sizes and parities (structs n, p0..p7) let two sets link; never false for two that do."""
    differ = sum((F.bit_count(F.col(f"{x}.{p}").bitwiseXOR(F.col(f"{y}.{p}"))) for p in PARITY), F.lit(0))
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))


def shard_blocks(keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) over sorted keys; shards are equal ranges of the keys' upper half."""
    at = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    edges = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(at)], strict=True):
        yield int(at[a]), a, b


class Heads:
    """The heads in a batch end to end: ``tokens``, the ``row`` of each, and for each row where its head begins (``first``, n + 1 entries)."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column("head").cast(pa.large_binary())
        self.first = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
        data = column.buffers()[2]
        tokens = np.frombuffer(data, "<u8", len(data) // 8) if data is not None else np.zeros(0, "<u8")
        self.tokens, self.first = tokens[self.first[0] : self.first[-1]], self.first - self.first[0]
        self.row = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.n = batch.column("n_shingles").to_numpy()
        self.ids = batch.column("doc_id").to_numpy()

    def ranks(self, frequent: FrequentClass, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tokens are rare, the rank of each among its row's rare ones, and which rows have a prefix of rare tokens in their head."""
        rare = ~frequent.of(self.tokens)
        total = np.r_[0, np.cumsum(rare)]
        return rare, total[1:] - total[self.first[self.row]], np.diff(total[self.first]) >= needed(self.n, percent)


def head_tokens(batches):
    for batch in batches:
        yield Heads(batch).tokens


def tail_tokens(size: int, percent: int):
    """The tokens of texts that no head has."""

    def run(batches):
        for batch in batches:
            for _, s in text_sets(batch, size):
                yield s[head_length(len(s), percent) :]

    return run


def count_blocks(tokens, shards: int):
    """Each map task's tokens with the number of its documents that hold them, by shard."""

    def flush(held: list[np.ndarray]):
        keys, counts = np.unique(np.concatenate(held) >> SHORT, return_counts=True)
        rows = [(k, b - a, pack(np.diff(keys[a:b], prepend=np.uint64(0)), 8), pack(counts[a:b], 4)) for k, a, b in shard_blocks(keys << SHORT, shards)]
        k, n, x, c = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(x, pa.binary()), pa.array(c, pa.binary())], names=["shard", "n", "keys", "counts"])

    def run(batches):
        held, n = [], 0
        for s in tokens(batches):
            if len(s):
                held.append(s)
                n += len(s)
            if n >= BLOCK_ENTRIES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def frequent_of(least: int):
    """The tokens of one shard (their upper 40 bits) that more than ``least`` documents hold."""

    def run(block: pa.Table) -> pa.Table:
        # a key of 40 bits and a count below 2**24 in one number: a block counts no token more often than it has entries
        both = np.sort(np.concatenate([np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64) << SHORT | unpack(r["counts"], r["n"], 4).astype(np.uint64) for r in block.to_pylist()]))
        k, c = both >> SHORT, (both & np.uint64((1 << 24) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        keep = np.add.reduceat(c, edge) > least
        return pa.table({"token": pa.array(k[edge][keep].view(np.int64), pa.int64())})

    return run


def frequent_tokens(rows: DataFrame, tokens, shards: int) -> DataFrame:
    blocks = rows.mapInArrow(count_blocks(tokens, shards), schema("shard int, n long, keys binary, counts binary"))
    return cut(blocks.repartitionById(shards, "shard").groupBy("shard").applyInArrow(frequent_of(FREQUENT), schema("token long")))


class FrequentClass:
    """Which tokens are of the frequent class: those that fall on a set bit of a filter of bounded size.

    A token that falls there by chance is of the class, too, in every document alike, so no link is
    lost, and a filter that fills up only makes more tokens frequent.
    """

    def __init__(self, maps: list, bits: int):
        self.bits = np.zeros(bits // 8, np.uint8)
        for r in maps:
            self.bits[r["bucket"] * (BITMAP // 8) : (r["bucket"] + 1) * (BITMAP // 8)] = np.frombuffer(bytes(r["bitmap"]), np.uint8)

    def of(self, s: np.ndarray) -> np.ndarray:
        slot = (s >> SHORT).astype(np.int64) & (8 * len(self.bits) - 1)
        return (self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def frequent_class(often: DataFrame):
    """The broadcast class of the tokens in a table."""
    bits = filter_bits(often.count(), CLASS_BITS)
    maps = bitmaps(often.select(F.col("token").bitwiseAND(F.lit(bits - 1)).alias("slot"))).collect()  # of bounded size
    return often.sparkSession.sparkContext.broadcast(FrequentClass(maps, bits))


def short_heads(percent: int, broadcast):
    """The documents whose head is not the whole set and holds too few rare tokens for a prefix."""

    def run(batches):
        for batch in batches:
            h = Heads(batch)
            short = ~h.ranks(broadcast.value, percent)[2] & (np.diff(h.first) < h.n)
            yield pa.RecordBatch.from_arrays([pa.array(h.ids[short], pa.int64())], names=["doc_id"])

    return run


def level_of(n: int) -> int:
    """0 for small sets; then one level for each doubling."""
    return 0 if n < SMALL_SET else (n // SMALL_SET).bit_length()


def signatures(s: np.ndarray, frequent: FrequentClass, percent: int) -> np.ndarray:
    """Index entries of one sorted set: two sets that link share at least one.

    From 50 percent up a set has enough tokens for the combinations of its level; below, all sets alike
    are indexed by single tokens.
    """
    n = len(s)
    least, need = n + 1 - needed(n, percent), needed(n, percent)
    often = frequent.of(s)
    rare, common = s[~often], s[often]
    if len(rare) >= need:
        return rare[:need]
    out = [rare]
    need -= len(rare)
    for level in range(level_of(least), level_of(n * 100 // percent) + 1) if percent >= 50 else (0,):
        if level == 0:
            out.append(common[:need])
            continue
        classes = np.uint64(SMALL_SET >> 2 << (level - 1))
        of = mix(common) % classes
        opens = np.zeros(len(common), bool)
        opens[np.unique(of, return_index=True)[1]] = True
        covered = np.cumsum(~opens)
        stop = int(np.searchsorted(covered, need)) + 1
        salt = np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        assert stop <= len(common), "a prefix covers the differences that a link allows"
        head, of = common[:stop], of[:stop]
        order = np.argsort(of, kind="stable")
        head, of = head[order], of[order]
        for gap in range(1, len(head)):
            same = of[gap:] == of[:-gap]
            if not same.any():
                break
            out.append(mix(head[gap:][same] * np.uint64(3) ^ mix(head[:-gap][same]) ^ salt))
    return np.unique(np.concatenate(out))


def head_entries(percent: int, broadcast):
    """Index entries (keys, documents, set sizes) of the documents whose heads suffice."""

    def run(batches):
        for batch in batches:
            h, need = Heads(batch), needed(batch.column("n_shingles").to_numpy(), percent)
            rare, rank, enough = h.ranks(broadcast.value, percent)
            at = np.flatnonzero(rare & (rank <= need[h.row]) & enough[h.row])
            yield h.tokens[at], h.ids[h.row[at]], h.n[h.row[at]]
            for i in np.flatnonzero(~enough & (np.diff(h.first) == h.n) & (h.n > 0)).tolist():
                keys = signatures(h.tokens[h.first[i] : h.first[i + 1]], broadcast.value, percent)
                yield keys, np.full(len(keys), h.ids[i]), np.full(len(keys), h.n[i])

    return run


def text_entries(size: int, percent: int, broadcast):
    """Index entries of whole texts."""

    def run(batches):
        for batch in batches:
            for d, s in text_sets(batch, size):
                if len(s):
                    keys = signatures(s, broadcast.value, percent)
                    yield keys, np.full(len(keys), d), np.full(len(keys), len(s))

    return run


def index_blocks(entries, shards: int):
    """Each map task's index entries (key, document, set size), by shard."""

    def flush(held: list):
        k, d, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(k)
        k, d, n = k[order], d[order].view(np.uint64), n[order]
        k48 = k >> np.uint64(16)
        rows = [(h, b - a, pack(np.diff(k48[a:b], prepend=np.uint64(0))), pack(d[a:b]), pack(n[a:b], 4)) for h, a, b in shard_blocks(k, shards)]
        h, c, x, y, z = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int32()), pa.array(c, pa.int64()), *(pa.array(v, pa.binary()) for v in (x, y, z))], names=["shard", "n", "keys", "docs", "sizes"])

    def run(batches):
        held, n = [], 0
        for entry in entries(batches):
            if len(entry[0]):
                held.append(entry)
                n += len(entry[0])
            if n >= BLOCK_ENTRIES:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def candidates_of(percent: int):
    """One shard's candidates: ``bucket`` is null for a pair of a small bucket, else names a large bucket's star."""

    def run(block: pa.Table) -> pa.Table:
        keys, docs, sizes = [], [], []
        for r in block.to_pylist():
            keys.append(np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64))
            docs.append(unpack(r["docs"], r["n"]).view(np.int64))
            sizes.append(unpack(r["sizes"], r["n"], 4).astype(np.int64))
        k, d, n = np.concatenate(keys), np.concatenate(docs), np.concatenate(sizes)
        order = np.argsort(k)
        k, d, n = k[order], d[order], n[order]
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        count = np.diff(np.r_[edge, len(k)])
        a, b = [], []
        within = np.repeat(count, count)
        left = np.repeat(edge + count, count) - np.arange(len(k)) - 1  # members that follow in the bucket
        small = within <= PAIR_BUCKET
        for gap in range(1, PAIR_BUCKET):
            i = np.flatnonzero(small & (left >= gap))
            j = i + gap
            ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (d[i] != d[j])
            a.append(np.minimum(d[i[ok]], d[j[ok]]))
            b.append(np.maximum(d[i[ok]], d[j[ok]]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0) if a else np.zeros((0, 2), np.int64)
        bucket, x, y, seen = [np.zeros(len(pairs), np.int64)], [pairs[:, 0]], [pairs[:, 1]], set()
        for e, c in zip(edge[count > PAIR_BUCKET].tolist(), count[count > PAIR_BUCKET].tolist(), strict=True):
            members = np.unique(d[e : e + c])
            name = int((mix(members.view(np.uint64)).sum(dtype=np.uint64) | np.uint64(1)).view(np.int64))
            if name not in seen and len(members) > 1:
                seen.add(name)
                bucket.append(np.full(len(members) - 1, name))
                x.append(np.full(len(members) - 1, members[0]))
                y.append(members[1:])
        bucket, x, y = np.concatenate(bucket), np.concatenate(x), np.concatenate(y)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "center": pa.array(x, pa.int64()), "member": pa.array(y, pa.int64())})

    return run


def close_pairs(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities let them link; sketches: (id, s)."""
    one, two = (sketches.select(F.col("id").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").where(close("sa", "sb", percent)).select("a", "b")


def least_difference(x: bytes, y: bytes) -> int:
    """A number of tokens by which two sets differ at least; the wider parities are folded to the narrower."""
    p, q = (np.frombuffer(v, np.uint8) for v in ((x, y) if len(x) <= len(y) else (y, x)))
    return int(np.bitwise_count(np.bitwise_xor.reduce(q.reshape(-1, len(p)), axis=0) ^ p).sum())


def packed_sets(size: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids, sets = zip(*text_sets(batch, size), strict=True)
                numbers = [ids, *fingerprints(sets), [len(s) for s in sets]]
                yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in numbers), pa.array([pack(np.diff(s, prepend=np.uint64(0))) for s in sets], pa.binary())], names=["id", "fp1", "fp2", "n", "x"])

    return run


def kept_pairs(test):
    """Keep the pairs of (a, b, n1, x1, n2, x2) that a test of (n1, x1, n2, x2) lets through."""

    def run(batches):
        for batch in batches:
            keep = [test(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("n1", "x1", "n2", "x2")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def may_link(percent: int):
    return lambda n1, p1, n2, p2: 100 * min(n1, n2) >= percent * max(n1, n2) and (100 + percent) * least_difference(p1, p2) <= (100 - percent) * (n1 + n2)


def do_link(percent: int):
    def test(n1, t1, n2, t2):
        both = np.concatenate([np.cumsum(unpack(t, n), dtype=np.uint64) for t, n in ((t1, n1), (t2, n2))])
        both.sort()
        common = int((both[1:] == both[:-1]).sum())
        return 100 * common >= percent * (n1 + n2 - common)

    return test


def ends(pairs: DataFrame) -> DataFrame:
    """The documents (id) in pairs (a, b)."""
    return cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())


def rows_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (doc_id, written before); few ids go to the rows, else only rows that may match shuffle."""
    return split_by_ids(docs, ids)[1].join(few(ids), "doc_id", "left_semi")


def tested_by(test, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that a test of their sets (id, n, x) lets through."""
    one, two = (sets.select(F.col("id").alias(e), F.col("n").alias(f"n{i}"), F.col("x").alias(f"x{i}")) for e, i in (("a", 1), ("b", 2)))
    return cut(pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "x1", "n2", "x2").mapInArrow(kept_pairs(test), schema("a long, b long")))


def link(docs: DataFrame, prints: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole texts link: first by wide parities, which never lose a link, then by all tokens.

    Only the texts of pairs that pass the parities are made into sets again; of rows that repeat an id, the one that has the prints counts.
    """
    pairs = tested_by(may_link(percent), pairs, prints.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.col("parity").alias("x")).join(few(ends(pairs)), "id", "left_semi"))
    if pairs.isEmpty():
        return pairs
    ids = ends(pairs).withColumnRenamed("id", "doc_id")
    sets = rows_of(docs, ids).select("doc_id", "text").mapInArrow(packed_sets(size), schema("id long, fp1 long, fp2 long, n long, x binary"))
    own = prints.join(few(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "fp1", "fp2")
    return tested_by(do_link(percent), pairs, cut(sets.join(own, ["id", "fp1", "fp2"], "left_semi").select("id", "n", "x")))


def apart_in(percent: int):
    """Distinct close pairs across components within the buckets of one group."""

    def run(block: pa.Table) -> pa.Table:
        bucket, ids, component, main, n = (block.column(c).to_numpy() for c in ("bucket", "id", "component", "main", "n"))
        order = np.argsort(bucket, kind="stable")
        bucket, ids, component, main, n = (v[order] for v in (bucket, ids, component, main, n))
        parities = np.stack([block.column(p).to_numpy()[order].view(np.uint64) for p in PARITY], axis=1)
        edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        found, held = [np.zeros((0, 2), np.int64)], 0
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True):
            outside = a + np.flatnonzero(component[a:b] != main[a:b])
            step = max(1, CELLS // (b - a))
            for k in range(0, len(outside), step):
                i = outside[k : k + step]
                differ = np.bitwise_count(parities[i][:, None, :] ^ parities[None, a:b, :]).sum(axis=2, dtype=np.int64)
                x, y = n[i][:, None], n[None, a:b]
                ok = (component[i][:, None] != component[None, a:b]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y)) & ((100 + percent) * differ <= (100 - percent) * (x + y))
                r, c = np.nonzero(ok)
                found.append(np.sort(np.stack([ids[i[r]], ids[a + c]], axis=1), axis=1))
                held += len(r)
                if held > CELLS:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    held = 0
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return run


def apart_pairs(members: DataFrame, count: int, percent: int) -> DataFrame:
    """Distinct close pairs (a, b) across components: members (bucket, id, component, main, total, s).

    Buckets of bounded size meet in groups of about ``GROUP_MEMBERS``, where pairs that share many
    buckets come out once; a larger bucket meets in a join, which can split it.
    """
    small = members.where(F.col("total") <= GROUP_MEMBERS).select(F.pmod(F.xxhash64("bucket"), F.lit(count // GROUP_MEMBERS + 1)).alias("g"), "bucket", "id", "component", "main", "s.*")
    out = small.groupBy("g").applyInArrow(apart_in(percent), schema("a long, b long"))
    large = members.where(F.col("total") > GROUP_MEMBERS)
    other = large.select("bucket", F.col("id").alias("center"), F.col("component").alias("other"), F.col("s").alias("sc"))
    met = large.where("component <> main").select("bucket", "id", "component", "s").join(other, "bucket").where(F.expr("component <> other") & close("s", "sc", percent))
    return out.union(met.select(F.least("id", "center"), F.greatest("id", "center"))).distinct()


def rejoined(docs: DataFrame, prints: DataFrame, held: DataFrame, sketches: DataFrame, tested: DataFrame, links: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links and components once the members (bucket, id) of large buckets that are still apart have met.

    Rounds of stars come first: in each bucket the members outside its most common component meet one
    member of that component, another in each round. When the pairs that are left are few for the
    number of members, or a round finds nothing, all pairs across components are verified.
    """
    found = True
    for turn in range(ROUNDS + 1):
        classes = components(links)
        named = held.join(classes, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        groups = named.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("id", F.lit(turn)), "id")).alias("head"))
        groups = groups.groupBy("bucket").agg(F.sum("m").alias("total"), F.max(F.struct("m", "component", "head")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
        groups = cut(groups.select("bucket", "total", F.col("main.m").alias("most"), F.col("main.component").alias("main"), F.col("main.head.id").alias("center")))
        members, pairs = groups.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(F.col("total") * (F.col("total") - F.col("most"))), F.lit(0))).first()
        if not members:
            return links, classes
        named = cut(named.join(groups.select("bucket", "main", "center", "total"), "bucket"))
        apart, last = named.where("component <> main"), turn == ROUNDS or not found or pairs <= EASY * members
        if last:
            rest = apart_pairs(named.join(sketches, "id"), members, percent)
        else:
            rest = close_pairs(apart.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct(), sketches, percent)
        rest = cut(rest.join(tested, ["a", "b"], "left_anti"))
        more = link(docs, prints, rest, size, percent)
        found = bool(more.take(1))
        links = links.union(more) if found else links
        if last:
            return links, components(links) if found else classes
        tested, held = tested.union(rest), named.select("bucket", "id")
    raise AssertionError("the last round returns")


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """Class of each document under links of Jaccard similarity of at least ``percent`` / 100.

    docs: doc_id long and text; other columns are ignored. Returns one row for each document: doc_id,
    n_shingles (0 for null, empty and blank texts, which link with nothing), component_id (smallest
    doc_id that links reach). Repeated texts count as links; texts may have any length. Rows that repeat
    a doc_id are one document, rows without one are none. An empty table gives no rows. Token hashes
    have 64 bits.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    spark = docs.sparkSession
    arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    wide = cut(docs.mapInArrow(sizes_and_prints(size, percent), schema(f"{PRINTS}, parity binary, head binary")))
    if wide.groupBy("doc_id").count().where("count > 1").take(1):
        wide = cut(wide.dropDuplicates(["doc_id"]))
    prints, some = wide.drop("parity", "head"), wide.where("n_shingles > 0").select("doc_id", "fp1", "fp2")
    first = cut(some.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").select(F.col("fp1").alias("f1"), F.col("fp2").alias("f2"), "rep"))
    rep = some.join(first, (F.col("fp1") == F.col("f1")) & (F.col("fp2") == F.col("f2")), "left")
    rep = cut(rep.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")))

    texts = without(wide.select("doc_id", "n_shingles", "head"), rep.where("rep <> doc_id"))
    total = prints.agg(F.sum(F.lit(9) + F.col("n_shingles") * (112.5 - percent) / 100)).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // SHARD_TOKENS))
    often = frequent_tokens(texts, head_tokens, shards)
    broadcast = frequent_class(often)
    short = cut(texts.mapInArrow(short_heads(percent, broadcast), schema("doc_id long")))
    if not short.isEmpty():
        often = cut(often.union(frequent_tokens(rows_of(docs, short), tail_tokens(size, percent), shards)).distinct())
        broadcast = frequent_class(often)
        short = cut(texts.mapInArrow(short_heads(percent, broadcast), schema("doc_id long")))

    index = schema("shard int, n long, keys binary, docs binary, sizes binary")
    blocks = texts.mapInArrow(index_blocks(head_entries(percent, broadcast), shards), index)
    if not short.isEmpty():
        blocks = blocks.union(rows_of(docs, short).mapInArrow(index_blocks(text_entries(size, percent, broadcast), shards), index))
    found = cut(blocks.repartitionById(shards, "shard").groupBy("shard").applyInArrow(candidates_of(percent), schema("bucket long, center long, member long")))
    sketches = prints.select(F.col("doc_id").alias("id"), F.struct(F.col("n_shingles").alias("n"), *PARITY).alias("s"))
    tested = cut(close_pairs(found.select(F.least("center", "member").alias("a"), F.greatest("center", "member").alias("b")).distinct(), sketches, percent))
    links = link(docs, wide, tested, size, percent)

    held = found.where("bucket <> 0")
    held = cut(held.select("bucket", F.col("member").alias("id")).union(held.select("bucket", F.col("center"))).distinct())
    links, classes = rejoined(docs, wide, held, sketches, tested, links, size, percent)

    named = rep.join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without those that a class of linked documents has a smaller doc_id for; all columns stay. Ids move, texts only to meet them."""
    classes = cut(jaccard_components(docs))
    gone = classes.where("component_id <> doc_id").select("doc_id")
    return without(docs, gone)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
