"""N-gram Jaccard join by signature trees: connected groups of texts whose shingle sets overlap.

A text's set is its distinct shingles of a rule's words (three, or five for near copies); two texts link when
the sets' Jaccard similarity is at least the rule's percentage. The result gives every document the smallest doc_id that links lead to. It is exact:

1. Equal sets become one, by a fingerprint and the size, so copies cost one row each and no pair.
2. The shingles of a set are ordered, presumably rare ones first. Linked sets share one among their
   first shingles (prefix filter), which become the roots: under each root stand the sets that have it in
   their prefix. Sets whose size no other set under the root can match are dropped.
3. The sets under a root form a signature tree: leaves of sets sorted by size and signature, whose nodes
   hold the OR of their sets' token bitmaps, the range of sizes, and how many tokens share bits at most. A
   dual traversal descends only into pairs of nodes whose largest possible overlap reaches the least one
   that a link needs.
4. Pairs that the leaves leave are verified on the whole sets.

Only groups are asked for, so no more pairs are made than connect them: first each set is paired with one
central set per root; once these links are known, the traversal skips pairs that are already connected.
A frequent root, which may hold a third of all sets, is dealt out in blocks of about BLOCK sets; the sets
outside its largest group visit every block, all others need not.

How rare a shingle is, is judged by a sample of the sets: by how frequent its words are, and by whether it
is among the FREQUENT most frequent ones. This only orders the shingles; any order gives the same result.

Null text, empty text, text without words: no shingles, linked with nothing, a group of its own. Fewer
words than a shingle has: the whole sequence is the one shingle. Null doc_ids never name a group that has another
one. Repeated rows link as copies. Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.llm.components import components
from quern.session import discard, staged

SIGNATURE_BITS = 1024
#: One set in this many is counted for the order of the shingles.
SAMPLED = 32
FREQUENT = 1 << 20
FREQUENT_WORDS = 1 << 16
#: Sets of a frequent root that one block holds, about; sets of a leaf; children of a node.
BLOCK = 2048
LEAF = 8
FAN = 8
#: Pairs that one cell of the verification holds, about.
CELL_PAIRS = 512
#: Bits of the map by which texts that no pair needs are passed over.
WANTED_BITS = 1 << 26

#: Slots of the map of roots, which is built in so many buckets; roots of a task that are packed at once.
ROOT_SLOTS = 1 << 27
ROOT_BUCKETS = 512
PACKED_ROOTS = 1 << 22

_WORD_BITS = 64
_KEY_SHIFT = 58
_FREQUENT_CLASS = np.uint64(48)


def _met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """The join by shuffles at every size. Small sides would else pass through the driver, and over the many joins
    of a run their hash tables and copies take more of its memory than anything else."""
    return left.join(right.hint("shuffle_merge"), on, how)


@dataclass(frozen=True)
class Rule:
    """What links: words of a shingle and the least Jaccard similarity in percent."""

    words: int
    percent: int

    @property
    def smallest(self) -> int:
        """The smallest set that can link with another than an equal one, which has one shingle more."""
        return -(-self.percent // (100 - self.percent))

    def least_size(self, n):
        """The smallest size that a set linked with one of size n can have."""
        return (self.percent * n + 99) // 100

    def least_overlap(self, a, b):
        """The smallest overlap of linked sets of sizes a and b."""
        whole = 100 + self.percent
        return (self.percent * (a + b) + whole - 1) // whole

    def probe_length(self, n):
        return n - self.least_size(n) + 1

    def index_length(self, n):
        """How many of its first shingles the smaller set of a pair needs."""
        return n - self.least_overlap(n, n) + 1


#: What the query asks for, and what makes texts near copies.
QUERY = Rule(3, 90)
NEAR_COPIES = Rule(5, 80)


def shingles_of(data: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and shingle hashes (of _KEY_SHIFT bits) of all texts, with the numbers before each text."""
    data = flat.lower_ascii(data)
    starts, ends, before = flat.word_spans(data, bounds)
    words = flat.span_hashes(data, starts, ends)
    runs, runs_before = flat.run_hashes(words, before, rule.words, short=True)
    return words, before, runs >> np.uint64(64 - _KEY_SHIFT), runs_before


def shingle_sets(data: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in rising order, and the shingles before each text."""
    _, _, runs, runs_before = shingles_of(data, bounds, rule)
    return flat.distinct_in_rows(runs, runs_before)


def fingerprints(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    return flat.signed(flat.mix(flat.row_sums(flat.mix(values), before) ^ np.diff(before).astype(np.uint64)))


def signatures(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A row of SIGNATURE_BITS bits, as bytes, for every set."""
    rows = len(before) - 1
    flags = np.zeros((rows, SIGNATURE_BITS), np.uint8)
    flags[np.repeat(np.arange(rows), np.diff(before)), (values >> np.uint64(20)).astype(np.int64) % SIGNATURE_BITS] = 1
    return np.packbits(flags, axis=1)


def _set_batches(rule: Rule):
    def run(batches):
        for batch in flat.pieces(batches, "text"):
            words, words_before, runs, runs_before = shingles_of(*flat.column(batch.column("text")), rule)
            values, before = flat.distinct_in_rows(runs, runs_before)
            prints = fingerprints(values, before)
            signed = signatures(values, before)
            bits = pa.array([s.tobytes() for s in signed], pa.binary())
            drawn = prints % SAMPLED == 0
            samples = [_lists(values, before, drawn), _lists(words, words_before, drawn)]
            columns = [batch.column("doc_id"), batch.column("t"), pa.array(np.diff(before)), pa.array(prints), bits, *samples]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "n", "f", "sig", "sample", "words"])

    return run


def _lists(values: np.ndarray, before: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """The values of the chosen rows as lists; the other rows have empty ones."""
    lengths = np.diff(before)
    ends = np.concatenate([[0], np.cumsum(np.where(rows, lengths, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.signed(values[np.repeat(rows, lengths)])))


def read_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, t (hash of the text), n (size), f (fingerprint), sig and, for sampled sets, shingles and words; written once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    return staged(rows.mapInArrow(_set_batches(rule), f"doc_id {kind}, t long, n long, f long, sig binary, sample array<long>, words array<long>"), "sets")


def frequencies(sets: DataFrame) -> dict[str, np.ndarray]:
    """From the sampled sets: the most frequent shingles and words, each in rising order with a class."""
    once = sets.where("size(sample) > 0").groupBy("f", "n").agg(F.first("sample").alias("sample"), F.first("words").alias("words"))
    out = {}
    for name, least, most in (("sample", 3, FREQUENT), ("words", 2, FREQUENT_WORDS)):
        counts = once.select(F.explode(name).alias("v")).groupBy("v").agg(F.count("*").alias("c")).where(F.col("c") >= least)
        got = counts.orderBy(F.col("c").desc(), "v").limit(most).toArrow()
        values, counts = np.ascontiguousarray(got["v"].to_numpy()).view(np.uint64), got["c"].to_numpy()
        order = np.argsort(values)
        out[name], out[f"{name}_class"] = values[order], np.floor(np.log2(counts[order])).astype(np.uint64)
    return out


def root_keys(words, words_before, runs, runs_before, known: dict, rule: Rule) -> np.ndarray:
    """The shingles as sortable keys, presumably rare ones first: a class above the hash.

    The class adds up how frequent a shingle's words are; a shingle that is itself frequent stands above.
    """
    at = flat.lookup(known["words"], words)
    word_class = np.where(at >= 0, np.minimum(known["words_class"][at] if len(known["words"]) else np.uint64(0), np.uint64(15)), np.uint64(0)).astype(np.uint64)
    lengths = np.diff(runs_before)
    first = np.repeat(words_before[:-1], lengths) + np.arange(len(runs)) - np.repeat(runs_before[:-1], lengths)
    level = np.zeros(len(runs), np.uint64)
    for k in range(rule.words):  # of a text shorter than a shingle, the order does not matter
        level += word_class[np.minimum(first + k, max(0, len(words) - 1))]
    level = level * np.uint64(3) // np.uint64(rule.words)  # below the frequent classes
    maybe = np.zeros(1 << 22, bool)
    maybe[(known["sample"] >> np.uint64(_KEY_SHIFT - 22)).astype(np.int64)] = True
    some = np.flatnonzero(maybe[(runs >> np.uint64(_KEY_SHIFT - 22)).astype(np.int64)])
    at = flat.lookup(known["sample"], runs[some])
    level[some[at >= 0]] = _FREQUENT_CLASS + np.minimum(known["sample_class"][at[at >= 0]], np.uint64(15))
    return runs | (level << np.uint64(_KEY_SHIFT))


def _entries(batches, known: dict, rule: Rule):
    """(roots, fingerprint, size and place of each) of a task's texts, one text of equal ones."""
    seen: set[int] = set()
    for batch in flat.pieces(batches, "text"):
        words, words_before, runs, runs_before = shingles_of(*flat.column(batch.column("text")), rule)
        keys, before = flat.distinct_in_rows(root_keys(words, words_before, runs, runs_before, known, rule), runs_before)
        n = np.diff(before)
        prints = fingerprints(keys & np.uint64((1 << _KEY_SHIFT) - 1), before)
        fresh = np.zeros(len(n), bool)
        for row in np.flatnonzero(n >= rule.smallest):  # smaller sets link with equal ones only
            if prints[row] not in seen:
                seen.add(int(prints[row]))
                fresh[row] = True
        rows = np.flatnonzero(fresh)
        take = rule.probe_length(n[rows])
        owner = np.repeat(np.arange(len(rows)), take)
        pos = np.arange(len(owner)) - np.repeat(np.cumsum(take) - take, take)
        yield keys[before[:-1][rows][owner] + pos], prints[rows][owner], n[rows][owner], pos


def _slots(roots: np.ndarray) -> np.ndarray:
    return (flat.mix(roots) % np.uint64(ROOT_SLOTS)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Rising numbers as their steps, low halves first, which compress well."""
    steps = np.diff(values, prepend=0).astype(np.uint32)
    return steps.astype("<u2").tobytes() + (steps >> 16).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u2").astype(np.int64).reshape(2, -1)
    return np.cumsum(halves[0] + (halves[1] << 16))


def _slot_batches(frequent, rule: Rule):
    """(bucket, slots): the slots of a task's roots, packed."""
    width = ROOT_SLOTS // ROOT_BUCKETS

    def packed(slots: np.ndarray):
        slots = np.sort(slots)
        edges = np.searchsorted(slots, np.arange(ROOT_BUCKETS + 1) * width)
        used = np.flatnonzero(np.diff(edges))
        data = [_packed(slots[edges[b] : edges[b + 1]] - b * width) for b in used]
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "slots"])

    def run(batches):
        held, count = [], 0
        for roots, _, _, _ in _entries(batches, frequent.value, rule):
            held.append(_slots(roots))
            count += len(roots)
            if count > PACKED_ROOTS:
                yield packed(np.concatenate(held))
                held, count = [], 0
        if count:
            yield packed(np.concatenate(held))

    return run


def _shared_batches(batches):
    """(bucket, bits): the slots of a bucket that stand twice or more, as a bit map."""
    width = ROOT_SLOTS // ROOT_BUCKETS
    now, once, more = None, None, None
    for batch in batches:
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("slots").to_pylist()):
            if bucket != now:
                if now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(more).tobytes()])], names=["bucket", "bits"])
                now, once, more = bucket, np.zeros(width, bool), np.zeros(width, bool)
            slots, counts = np.unique(_unpacked(data), return_counts=True)
            more[slots[once[slots] | (counts > 1)]] = True
            once[slots] = True
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(more).tobytes()])], names=["bucket", "bits"])


def shared_roots(docs: DataFrame, frequent, rule: Rule) -> np.ndarray:
    """A bit map of fixed size: the slots of roots that may stand under two sets.

    A root whose slot is not in it stands under one set, links nothing and need not be shuffled. With more roots
    than slots it lets most of them through, which costs room but changes nothing.
    """
    packed = docs.select("text").mapInArrow(_slot_batches(frequent, rule), "bucket int, slots binary")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    width = ROOT_SLOTS // ROOT_BUCKETS // 8
    bits = np.zeros((ROOT_BUCKETS, width), np.uint8)
    for row in dealt.mapInArrow(_shared_batches, "bucket int, bits binary").toLocalIterator():  # ROOT_BUCKETS rows
        bits[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.ravel()


def _entry_batches(frequent, shared, rule: Rule):
    def run(batches):
        bits = shared.value
        for roots, prints, n, pos in _entries(batches, frequent.value, rule):
            slot = _slots(roots)
            keep = (bits[slot >> 3] >> (7 - (slot & 7))) & 1 > 0
            columns = [pa.array(flat.signed(roots[keep])), pa.array(prints[keep]), pa.array(n[keep].astype(np.int32)), pa.array(pos[keep].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["root", "f", "n", "pos"])

    return run


def _blocks(root):
    """Blocks of a root, by the class of its frequency in the sample; 1 for all that are not frequent."""
    level = F.shiftrightunsigned(root, _KEY_SHIFT) - int(_FREQUENT_CLASS)
    return F.when(level < 0, F.lit(1)).otherwise(F.greatest(F.lit(1), (F.pow(F.lit(2.0), level) * SAMPLED / BLOCK).cast("int")))


def _groups(batches):
    """The sorted rows as runs of whole (root, salt) groups: a batch's last group waits for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows < 1 << 14:
            continue
        root, salt = held["root"].to_numpy(), held["salt"].to_numpy()
        last = np.flatnonzero((root != root[-1]) | (salt != salt[-1]))
        if len(last):
            yield held.slice(0, last[-1] + 1).combine_chunks()
            held = held.slice(last[-1] + 1).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _matched_batches(rule: Rule):
    """Rows that another row of their group may link with by size; rows of frequent roots all stay."""

    def run(batches):
        for table in _groups(batches):
            root, f = table["root"].to_numpy(), table["f"].to_numpy()
            first = np.ones(len(root), bool)  # the others are copies read by other tasks
            first[1:] = (root[1:] != root[:-1]) | (f[1:] != f[:-1])
            table = table.filter(pa.array(first))
            root, n = table["root"].to_numpy(), table["n"].to_numpy()
            follows = (root[1:] == root[:-1]) & (n[:-1] >= rule.least_size(n[1:].astype(np.int64)))
            keep = root.view(np.uint64) >> np.uint64(_KEY_SHIFT) >= _FREQUENT_CLASS
            keep[1:] |= follows
            keep[:-1] |= follows
            yield from table.filter(pa.array(keep)).select(["root", "f", "n", "pos"]).to_batches()

    return run


def rooted_sets(docs: DataFrame, frequent: dict, rule: Rule) -> DataFrame:
    """(root, f, n, pos): the sets under each root, without those that no size matches; written once."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(frequent)
    shared = context.broadcast(shared_roots(docs, sent, rule))
    entries = docs.select("text").mapInArrow(_entry_batches(sent, shared, rule), "root long, f long, n int, pos int")
    salted = entries.withColumn("salt", F.pmod("f", _blocks(F.col("root"))).cast("int"))
    dealt = salted.repartition("root", "salt").sortWithinPartitions("root", "salt", "n", "f")
    # Equal rows share root and salt, so a task has left one of them.
    found = staged(dealt.mapInArrow(_matched_batches(rule), "root long, f long, n int, pos int"), "roots")
    sent.destroy()
    shared.destroy()
    return found


def _may_link(n_a, pos_a, n_b, pos_b, percent: int):
    """For the smaller set a and the larger b, sharing the shingle at these places and none before."""
    need = F.ceil(percent * (n_a + n_b) / F.lit(100 + percent))
    return (100 * n_a >= percent * n_b) & (pos_a < n_a - F.ceil(2 * percent * n_a / F.lit(100 + percent)) + 1) & (F.least(n_a - pos_a, n_b - pos_b) >= need)


def central_pairs(rooted: DataFrame, rule: Rule) -> DataFrame:
    """(fa, fb): every set with the central one of each of its roots, the one with the fewest rarer shingles."""
    central = rooted.groupBy("root").agg(F.min(F.struct("pos", "f", "n")).alias("c"))
    both = _met(rooted, central, "root").where(F.col("f") != F.col("c.f"))
    smaller = (F.col("n") < F.col("c.n")) | ((F.col("n") == F.col("c.n")) & (F.col("f") < F.col("c.f")))
    own, other = [F.col(x) for x in ("n", "pos")], [F.col(f"c.{x}") for x in ("n", "pos")]
    good = F.when(smaller, _may_link(*own, *other, rule.percent)).otherwise(_may_link(*other, *own, rule.percent))
    return both.where(good).select(F.least("f", "c.f").alias("fa"), F.greatest("f", "c.f").alias("fb")).distinct()


def possible_overlap(bits_a, spare_a, bits_b, spare_b):
    """The most shingles two sets can share: common bits, and what shares a bit within either set."""
    return np.bitwise_count(bits_a & bits_b).sum(axis=-1).astype(np.int64) + np.minimum(spare_a, spare_b)


class _Tree:
    """Levels of nodes over the sets of a root: leaves first, the top last."""

    def __init__(self, n, bits, spare, comp):
        self.levels = []
        low, high, step = n, n, LEAF
        least, most = comp, comp
        while True:
            edges = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
            bits, spare = np.bitwise_or.reduceat(bits, edges, axis=0), np.maximum.reduceat(spare, edges)
            least, most = np.minimum.reduceat(least, edges), np.maximum.reduceat(most, edges)
            self.levels.append((low, high, bits, spare, least, most))
            if len(low) == 1:
                return
            step = FAN


def tree_pairs(n, pos, bits, comp, guest, rule: Rule = QUERY) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b), a the smaller set, of all pairs under one root that the tree cannot rule out.

    The sets come sorted by size; pairs of one component are left out, and so are pairs of two guests.
    """
    spare = n - np.bitwise_count(bits).sum(axis=1)
    if len(n) <= LEAF:
        a, b = np.triu_indices(len(n), 1)
    else:
        # Sets of about the same size stand together by their signature, so that nodes stay selective.
        order = np.lexsort((*bits[:, :4].T[::-1], np.floor(np.log(n) / np.log(100 / rule.percent))))
        tree = _Tree(n[order], bits[order], spare[order], comp[order])
        left, right = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth in range(len(tree.levels) - 1, -1, -1):
            low, high, node_bits, node_spare, least, most = tree.levels[depth]
            good = (100 * high[left] >= rule.percent * low[right]) & (100 * high[right] >= rule.percent * low[left])
            good &= (least[left] != most[left]) | (least[right] != most[right]) | (least[left] != least[right])
            left, right = left[good], right[good]
            most_shared = np.concatenate([possible_overlap(node_bits[left[i : i + 4096]], node_spare[left[i : i + 4096]], node_bits[right[i : i + 4096]], node_spare[right[i : i + 4096]]) for i in range(0, len(left), 4096)] or [np.zeros(0, np.int64)])
            good = most_shared >= rule.least_overlap(low[left], low[right])
            left, right = left[good], right[good]
            fan, size = (FAN, len(tree.levels[depth - 1][0])) if depth else (LEAF, len(n))
            left = (left[:, None, None] * fan + np.arange(fan)[None, :, None] + np.zeros((1, 1, fan), np.int64)).ravel()
            right = (right[:, None, None] * fan + np.arange(fan)[None, None, :] + np.zeros((1, fan, 1), np.int64)).ravel()
            inside = (left < size) & (right < size) & ((left <= right) if depth else (left < right))
            left, right = left[inside], right[inside]
        left, right = order[left], order[right]
        a, b = np.minimum(left, right), np.maximum(left, right)
    good = (comp[a] != comp[b]) & ~(guest[a] & guest[b])
    a, b = a[good], b[good]
    a, b = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
    need = rule.least_overlap(n[a], n[b])
    good = (n[a] >= rule.least_size(n[b])) & (pos[a] < rule.index_length(n[a])) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need)
    a, b, need = a[good], b[good], need[good]
    good = possible_overlap(bits[a], spare[a], bits[b], spare[b]) >= need
    return a[good], b[good]


def _words_of(column) -> np.ndarray:
    """Signatures as rows of 64-bit words."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = SIGNATURE_BITS // 8
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return data.reshape(-1, width).view(np.uint64)


def _tree_batches(rule: Rule):
    def run(batches):
        for table in _groups(batches):
            root, salt, f, n, pos, comp = (table[c].to_numpy() for c in ("root", "salt", "f", "n", "pos", "comp"))
            n, pos, guest = n.astype(np.int64), pos.astype(np.int64), table["guest"].to_numpy(zero_copy_only=False)
            bits = _words_of(table["sig"])
            edges = np.flatnonzero(np.concatenate([[True], (root[1:] != root[:-1]) | (salt[1:] != salt[:-1])]))
            found = []
            for low, high in zip(edges, np.append(edges[1:], len(root))):
                if high - low < 2 or (comp[low:high] == comp[low]).all():
                    continue
                a, b = tree_pairs(n[low:high], pos[low:high], bits[low:high], comp[low:high], guest[low:high], rule)
                if len(a):
                    found.append(np.stack([f[low + a], f[low + b]]))
            if found:
                pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["fa", "fb"])

    return run


def traversed_pairs(rooted: DataFrame, reps: DataFrame, labels: DataFrame, rule: Rule) -> DataFrame:
    """(fa, fb): pairs of different components that the trees of all roots leave.

    labels: (f, comp). In a root of several blocks, sets outside its largest component are guests of the
    blocks that are not their own.
    """
    rows = _met(rooted, labels, "f", "left").withColumn("comp", F.coalesce("comp", "f"))
    # Most roots hold sets of one component only, which need neither a tree nor their signatures.
    mixed = rows.groupBy("root").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_low < _high").select("root")
    rows = staged(_met(rows, mixed, "root", "left_semi"), "mixed").withColumn("blocks", _blocks(F.col("root")))
    few = rows.where("blocks = 1").select("root", F.lit(0).alias("salt"), "f", "n", "pos", "comp", F.lit(False).alias("guest"))
    many = rows.where("blocks > 1")
    sizes = many.groupBy("root", "comp").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("root").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"), F.count("*").alias("kinds")).where("kinds > 1")
    own = F.pmod("f", F.col("blocks")).cast("int")
    split = _met(many, largest, "root").withColumn("own", own)
    every = F.when(F.col("comp") == F.col("largest"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    split = split.select("root", F.explode(every).alias("salt"), "f", "n", "pos", "comp", "own").withColumn("guest", F.col("salt") != F.col("own")).drop("own")
    signed = _met(few.unionByName(split), reps.select("f", "sig"), "f")
    dealt = signed.repartition("root", "salt").sortWithinPartitions("root", "salt", "n", "f")
    return dealt.mapInArrow(_tree_batches(rule), "fa long, fb long").distinct()


def _bound_batches(rule: Rule):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = _words_of(batch.column("sig_a")), _words_of(batch.column("sig_b"))
                n_a, n_b = batch.column("n_a").to_numpy().astype(np.int64), batch.column("n_b").to_numpy().astype(np.int64)
                spare = [n - np.bitwise_count(x).sum(axis=1) for n, x in ((n_a, a), (n_b, b))]
                keep = possible_overlap(a, spare[0], b, spare[1]) >= rule.least_overlap(n_a, n_b)
                yield batch.select(["fa", "fb"]).filter(pa.array(keep))

    return run


def bounded_pairs(pairs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """The pairs whose signatures leave a link possible."""
    side = lambda x: reps.select(F.col("f").alias(f"f{x}"), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
    return _met(_met(pairs, side("a"), "fa"), side("b"), "fb").mapInArrow(_bound_batches(rule), "fa long, fb long")


def _wanted_batches(wanted, rule: Rule):
    def run(batches):
        flags = wanted.value
        for batch in batches:
            key = batch.column("k").to_numpy()
            slot = key & (WANTED_BITS - 1)
            keep = (flags[slot >> 6] >> (slot & 63)) & 1 > 0
            for some in flat.pieces([batch.filter(pa.array(keep))], "text"):
                values, before = shingle_sets(*flat.column(some.column("text")), rule)
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(flat.signed(values)))
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(values, before)), lists], names=["f", "shingles"])

    return run


def whole_sets(docs: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(f, shingles) of the wanted sets; written once. wanted: f and k, the hash of a doc_id that has it.

    A bit map of fixed size passes over the texts that are not wanted; what it lets through beside them
    falls to the join.
    """
    slot = F.col("k").bitwiseAND(F.lit(WANTED_BITS - 1))
    bits = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, int(k & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got = bits.toArrow()  # at most WANTED_BITS / 64 rows
    flags = np.zeros(WANTED_BITS // _WORD_BITS, np.int64)
    flags[got["w"].to_numpy()] = got["b"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(flags)
    found = docs.select(F.xxhash64("doc_id").alias("k"), "text").mapInArrow(_wanted_batches(sent, rule), "f long, shingles array<long>")
    kept = staged(_met(found, wanted.select("f"), "f", "left_semi").dropDuplicates(["f"]), "shingles")
    sent.destroy()
    return kept


def _verify_cell(rule: Rule):
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        """The pairs of a cell that link; sets: f, shingles of all sets that the pairs name."""
        lists = sets["shingles"].combine_chunks() if sets.num_rows else None
        place = {f: i for i, f in enumerate(sets["f"].to_pylist())}
        held: dict[int, np.ndarray] = {}

        def of(f: int) -> np.ndarray:
            if f not in held:
                held[f] = lists[place[f]].values.to_numpy()
            return held[f]

        found = []
        for fa, fb in zip(pairs["fa"].to_pylist(), pairs["fb"].to_pylist()):
            a, b = of(fa), of(fb)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            if 100 * shared >= rule.percent * (len(a) + len(b) - shared):
                found.append((fa, fb))
        return pa.table({"u": pa.array([x[0] for x in found], pa.int64()), "v": pa.array([x[1] for x in found], pa.int64())})

    return run


def verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, rule: Rule) -> DataFrame:
    """(u, v): the pairs that link, by their whole sets. pairs: fa, fb.

    A pair is verified in a cell of its set with more pairs, about CELL_PAIRS to a cell, and each set is sent once
    to every cell that names it: one with many pairs to a few cells of its own, the others to it. So about one
    set is sent per pair, at every number of pairs.
    """
    pairs = staged(pairs, "pairs")
    degrees = staged(pairs.select(F.explode(F.array("fa", "fb")).alias("f")).groupBy("f").agg(F.count("*").alias("d")), "degrees")
    cells = max(1, pairs.count() // CELL_PAIRS)
    known = pairs
    for side in ("a", "b"):
        known = _met(known, degrees.select(F.col("f").alias(f"f{side}"), F.col("d").alias(f"d{side}")), f"f{side}")
    own, other = F.greatest("da", "db"), F.when(F.col("da") > F.col("db"), F.col("fb")).when(F.col("da") < F.col("db"), F.col("fa")).otherwise(F.least("fa", "fb"))
    key = F.when(other == F.col("fa"), F.col("fb")).otherwise(F.col("fa"))
    row = F.pmod(F.xxhash64(key), F.lit(cells)).cast("int").alias("row")
    col = F.pmod(F.xxhash64(other), F.ceil(own / CELL_PAIRS)).cast("int").alias("col")
    # Written, as both sides of the cells read it and would else hold the joins before it twice.
    dealt = staged(known.select("fa", "fb", row, col), "dealt")
    discard(pairs)
    wanted = staged(_met(reps.select("f", "k"), degrees.select("f"), "f"), "wanted")
    discard(degrees)
    sets = whole_sets(docs, wanted, rule)
    named = dealt.select(F.col("row").alias("r"), F.col("col").alias("c"), F.explode(F.array("fa", "fb")).alias("f")).distinct()
    held = _met(named, sets, "f").select("r", "c", "f", "shingles")
    links = dealt.groupBy("row", "col").cogroup(held.groupBy("r", "c")).applyInArrow(_verify_cell(rule), "u long, v long")
    links = staged(links, "links")
    discard(dealt, sets, wanted)
    return links


def grouped_sets(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """The sets of read_sets, and (f, n, group): a label for every distinct set, equal within a group."""
    sets = read_sets(docs, rule)
    reps = staged(sets.where("n > 0").groupBy("f", "n").agg(F.min("doc_id").alias("least"), F.first("sig").alias("sig")).withColumn("k", F.xxhash64("least")), "reps")
    rooted = rooted_sets(docs, frequencies(sets), rule)
    first = verified(bounded_pairs(central_pairs(rooted, rule), reps, rule), docs, reps, rule)
    labels = components(first).select(F.col("v").alias("f"), F.col("label").alias("comp"))
    second = verified(traversed_pairs(rooted, reps, labels, rule), docs, reps, rule)
    discard(rooted)
    # The first links count by the stars they have become, which need no rounds of their own.
    known = labels.select(F.col("f").alias("u"), F.col("comp").alias("v"))
    labels = components(known.unionByName(second)).select(F.col("v").alias("f"), F.col("label").alias("group"))
    return sets, _met(reps.select("f", "n", "least"), labels, "f", "left").withColumn("group", F.coalesce("group", "f"))


def link_groups(docs: DataFrame, rule: Rule = QUERY) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, grouped = grouped_sets(docs, rule)
    least = grouped.groupBy("group").agg(F.min("least").alias("group_id"))
    named = _met(grouped, least, "group").select("f", "n", "group_id")
    out = _met(sets.select("doc_id", "n", "f"), named, ["f", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, rule: Rule = NEAR_COPIES) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, all columns as they are.

    Texts without words are groups of their own. Rows that are equal in doc_id and text are one document.
    """
    sets, grouped = grouped_sets(docs, rule)
    member = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    of_groups = _met(sets.where("n > 0"), grouped.select("f", "n", "group"), ["f", "n"]).groupBy("group").agg(F.min(member).alias("m")).select("m.doc_id", "m.t")
    kept = of_groups.unionByName(sets.where("n = 0").select("doc_id", "t"))
    kept = staged(kept.select(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).distinct(), "kept")
    keyed = docs.withColumns({"_doc": F.col("doc_id"), "_text": F.xxhash64("text")})
    found = _met(keyed, kept, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")))
    return found.dropDuplicates(["_doc", "_text"]).select(*[found[f"`{c}`"] for c in docs.columns])
