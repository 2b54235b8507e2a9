"""Language-model scoring with a weighted backoff automaton over words.

Counted n-grams (up to three words) that stand at least LEAST times in the training texts become states
and arcs, at every size of the corpus: a state is a kept history of one or two words, an arc a kept next
word with its interpolated, discounted probability, and a failure arc leads to the history without its
first word and carries the backoff weight. The score of a text is the log10 weight of the path that reads
it, closed by an end token.

The frequent part of the automaton, n-grams that make up at least SENT_SHARE of all training tokens, is sent
to every task and traversed there; no more than 1 / SENT_SHARE n-grams of an order can reach the share. The
rest stays in distributed tables that grow with the corpus. What a rare n-gram changes in the score of a
text that holds it (its arc's log weight less that of the failure path, plus its own backoff weight as a
history) does not depend on the rest of the text, so the hashes of the texts' rare n-grams travel to the
tables by shuffled joins and the sums come back: first those of the triples, whose sums become a value of their
text, then those of words and pairs, each text's own figures among them. So at no time do more than about half
of them lie on disk. Bit maps of fixed size pass over most n-grams that the tables lack. Tables and broadcasts go
as soon as nothing reads them, since the disk they take grows with the kept n-grams.

Tasks merge equal n-grams before they hand them on, so Spark moves them as arrays, a row for each range of their hashes, and a
group merges the arrays of its range. The number of ranges grows with the tokens, so that a group stays small.

Null text: as an empty text, which is one end token. Empty table: empty result. No training text: every
token has the same smoothed probability. Repeated rows and doc_ids are scored row by row and counted as
often as they stand. Other columns are not read. Words, pairs and triples are compared by 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import flat
from quern.llm.columns import remainder
from quern.session import discard, staged

ORDER = 3
#: The smallest count of a kept n-gram, and the share of all tokens from which it is sent to every task.
LEAST = 2
SENT_SHARE = 1e-6
DISCOUNT = 0.75
ADDED = 0.1
FOLDS = 10
#: Ids take this many bits in packed n-grams; 1 / SENT_SHARE must be below 2 ** ID_BITS.
ID_BITS = 20
#: Counted values that a task gathers before it merges equal ones; with HAND_ON, this sets the memory of a counting task.
MERGE_AT = 1 << 20
#: Tokens that one lane of the traversal reads.
LANE = 128
#: Bits of the maps by which n-grams that are not kept are passed over.
KEPT_BITS = 1 << 27

END = np.uint64(0x0E4D0E4D0E4D0E4D)


def _tokens(batch, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a batch, an end after every text, and the tokens before each row."""
    data, bounds = flat.column(batch.column(text))
    data = flat.lower_ascii(data)
    starts, ends, before = flat.word_spans(data, bounds)
    rows = len(bounds) - 1
    out = np.full(len(starts) + rows, END, np.uint64)
    at = np.arange(len(starts)) + np.repeat(np.arange(rows), np.diff(before))
    out[at] = flat.short_hashes(data, starts, ends)
    return out, before + np.arange(rows + 1)


class _Counter:
    """Equal values are merged as they come, so a task holds its distinct values and little more."""

    def __init__(self):
        self.values, self.counts, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(values)
        self.size += len(values)
        if self.size >= MERGE_AT:
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        new, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
        every = np.concatenate([self.values, new])
        weights = np.concatenate([self.counts, counts])
        order = np.argsort(every, kind="stable")
        every, weights = every[order], weights[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.values, self.counts = every[first], np.add.reduceat(weights, first) if len(every) else weights
        self.waiting, self.size = [], 0

    def batches(self, step: int = 1 << 17):
        self.merge()
        for at in range(0, len(self.values), step):
            yield pa.RecordBatch.from_arrays([pa.array(self.values[at : at + step]), pa.array(self.counts[at : at + step])], names=["v", "n"])


#: A task hands on what it has counted once it holds this many distinct values; Spark adds up its parts before the shuffle.
HAND_ON = 1 << 20


def _counted(values_of):
    def run(batches):
        counter = _Counter()
        for batch in flat.pieces(batches, "text"):
            counter.add(values_of(batch))
            if len(counter.values) > HAND_ON:
                yield from counter.batches()
                counter = _Counter()
        yield from counter.batches()

    return run


def _count(texts: DataFrame, values_of) -> DataFrame:
    return texts.mapInArrow(_counted(values_of), "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))


def _gram_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a pair from those of its words, or of a triple from those of its two pairs."""
    return flat.signed(flat.mix(flat.mix(a.view(np.uint64)) + b.view(np.uint64)))


class _GramCounter:
    """Equal (a, b) are merged as they come, as in _Counter."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.held, self.waiting, self.size = (none, none, none, np.zeros(0, np.int32)), [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.size += len(a)
        if self.size >= MERGE_AT // 2:  # a gram takes the room of two values
            self.merge()

    @staticmethod
    def _merged(parts: list[list[np.ndarray]]) -> tuple:
        """The rows of parts (columns key, a, b, n) with equal keys added up; takes the columns out of parts one by one, to hold few at a time."""
        keys = np.concatenate([x.pop(0) for x in parts])
        order = np.argsort(keys)  # in any order among equal keys, as their a and b are equal too
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        keys, chosen = keys[first], order[first]
        a, b = (np.concatenate([x.pop(0) for x in parts])[chosen] for _ in range(2))
        n = np.concatenate([x.pop(0) for x in parts])
        return keys, a, b, np.add.reduceat(n[order], first) if len(first) else n

    def merge(self) -> None:
        waiting, self.waiting, self.size = self.waiting, [], 0
        if not waiting:
            return
        a, b = (np.concatenate([x[i] for x in waiting]) for i in range(2))
        del waiting
        new = [_gram_key(a, b), a, b, np.ones(len(a), np.int32)]
        del a, b
        held, self.held = list(self.held), ()
        self.held = self._merged([held, new])

    def batches(self, step: int = 1 << 17):
        self.merge()
        _, a, b, n = self.held
        for at in range(0, len(a), step):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + step].astype(np.int64)) for x in (a, b, n)], names=["a", "b", "n"])


def _counted_grams(grams_of):
    def run(batches):
        counter = _GramCounter()
        for batch in flat.pieces(batches, "text"):
            counter.add(*grams_of(batch))
            if len(counter.held[0]) > HAND_ON // 2:
                yield from counter.batches()
                counter = _GramCounter()
        yield from counter.batches()

    return run


#: Grams are merged in groups of about so many occurrences, so a group stays small at every size of the corpus.
GROUP_GRAMS = 1 << 18


def _group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each key, out of equal ranges of keys; rising keys have rising groups."""
    return (((keys >> 32) + (1 << 31)) * groups) >> 32


def _grouped(batches, groups: int):
    """(a, b, n) of rising keys as one row for each group, its columns arrays: Spark moves them at a small part of what single rows cost."""
    for batch in batches:
        columns = [x.to_numpy() for x in batch.columns]
        group = _group_of(_gram_key(*columns[:2]), groups)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        bounds = pa.array(np.append(first, len(group)), pa.int32())
        columns[2] = columns[2].astype(np.int32)  # no task counts more of a gram before it hands on
        yield pa.RecordBatch.from_arrays([pa.array(group[first]), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in columns)], names=["g", "a", "b", "n"])


def _count_grams(texts: DataFrame, grams_of, least: float, total: int) -> DataFrame:
    """(a, b, n, k) of all grams that stand at least so often, k their hash; written once. total: the tokens of all texts."""
    groups = max(1, min(-(-total // GROUP_GRAMS), 1 << 30))

    def rows(batches):
        yield from _grouped(_counted_grams(grams_of)(batches), groups)

    def merged(table: pa.Table) -> pa.Table:
        a, b, n = (pc.list_flatten(table.column(c)).to_numpy() for c in "abn")
        k, a, b, n = _GramCounter._merged([[_gram_key(a, b), a, b, n.astype(np.int64)]])
        often = n >= least
        return pa.table({c: x[often] for c, x in (("a", a), ("b", b), ("n", n), ("k", k))})

    packed = texts.mapInArrow(rows, "g long, a array<long>, b array<long>, n array<int>")
    return staged(packed.groupBy("g").applyInArrow(merged, "a long, b long, n long, k long"), "grams")


def _slot(keys: np.ndarray) -> np.ndarray:
    """The bit of each key in a map, by its first bits: rising keys have rising slots from 0 on, those below 0 after them."""
    return (keys >> (65 - KEPT_BITS.bit_length())) & (KEPT_BITS - 1)


def _kept_map(kept: DataFrame, key: str) -> np.ndarray:
    """A map of KEPT_BITS bits with one set for every key; others may share it. Grams stand by their groups, so most share a word of bits with their neighbours."""

    def words_of_bits(batches):
        for batch in batches:
            slot = np.sort(_slot(batch.column(0).to_numpy()))
            word = slot >> 6
            first = np.flatnonzero(np.diff(word, prepend=-1))
            bits = np.bitwise_or.reduceat(np.left_shift(1, slot & 63), first) if len(first) else word
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits)], names=["w", "b"])

    bits = staged(kept.select(key).mapInArrow(words_of_bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")), "map")  # at most KEPT_BITS / 64 rows; written, so that the shuffle files go
    got = bits.toArrow()
    discard(bits)
    flags = np.zeros(KEPT_BITS // 64, np.int64)
    flags[got["w"].to_numpy()] = got["b"].to_numpy()
    return flags


def _may_hold(flags: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slot(keys)
    return (flags[slot >> 6] >> (slot & 63)) & 1 > 0


def _pairs(kept_words: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All runs of two tokens within texts, and whether both words may be kept; nothing follows an end."""
    words = flat.signed(tokens)
    kept = _may_hold(kept_words, words)
    return words, kept[:-1] & kept[1:] & (tokens[:-1] != END)


def _triples(kept_words: np.ndarray, kept_pairs: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, which neighbours may be kept pairs, the hashes of all neighbours, and which of these in turn may be triples."""
    words, good = _pairs(kept_words, tokens)
    keys = _gram_key(words[:-1], words[1:])
    good &= _may_hold(kept_pairs, keys)
    return words, good, keys, good[:-1] & good[1:]


def word_ids(words: flat.Places, tokens: np.ndarray) -> np.ndarray:
    """The id of every token among the kept words (sorted hashes), or -1."""
    return words.find(flat.signed(tokens))


def weighted(counts: DataFrame, pairs: DataFrame, triples: DataFrame, whole: float, sent_from: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The arcs and backoff weights of all kept n-grams; pairs and triples are discarded as soon as they are read.

    Probabilities are interpolated: (c - D) / c(history) plus the history's backoff weight times the
    probability after the shorter history. words: v, n, p (smoothed share), fail. pairs and triples: k, n, p,
    over (what the arc adds to the log10 weight of the failure path), and a and b of those that stand at least
    sent_from times; pairs also have fail.
    """

    def slim(rows, *columns):
        often = F.col("n") >= sent_from
        return rows.select("k", "n", "over", *columns, *[F.when(often, F.col(c)).alias(c) for c in ("a", "b")])

    def with_fail(rows, key, longer):
        sums = longer.groupBy("a").agg(F.sum(F.col("n") - DISCOUNT).alias("_s")).withColumnRenamed("a", key)
        fail = F.greatest(1 - F.coalesce("_s", F.lit(0.0)) / F.col("n"), F.lit(1e-12))
        return rows.join(sums.hint("shuffle_hash"), key, "left").withColumn("fail", fail).drop("_s")

    def with_arcs(rows, shorter, key):
        history = shorter.select(F.col(key).alias("a"), F.col("n").alias("_n"), F.col("fail").alias("_fail"))
        lower = shorter.select(F.col(key).alias("b"), F.col("p").alias("_p"))
        met = rows.join(history.hint("shuffle_hash"), "a").withColumn("a", F.when(F.col("n") >= sent_from, F.col("a")))  # nothing else reads it
        both = met.join(lower.hint("shuffle_hash"), "b").withColumn("p", (F.col("n") - DISCOUNT) / F.col("_n") + F.col("_fail") * F.col("_p"))
        return both.withColumn("over", F.log10("p") - F.log10("_fail") - F.log10("_p")).drop("_n", "_fail", "_p")

    words = staged(with_fail(counts, "v", pairs).withColumn("p", (F.col("n") + ADDED) / F.lit(whole)), "word_weights")
    arcs = staged(slim(with_arcs(pairs, words, "v"), "p"), "arcs")  # written between, so that shuffle files go
    discard(pairs)
    pairs = staged(with_fail(arcs, "k", triples), "pair_weights")
    discard(arcs)
    often = F.when(F.col("n") >= sent_from, F.col("p")).alias("p")
    longest = staged(slim(with_arcs(triples, pairs, "k"), often), "triple_weights")
    discard(triples)
    return words, pairs, longest


def rare_values(words: DataFrame, pairs: DataFrame, sums: DataFrame, sent_from: float) -> DataFrame:
    """(k, n, more): what each kept word and pair that is not in the automaton, and a text's triples, add to a score; n of words only; written once."""

    def value(rows, key, n, more):
        return rows.select(F.col(key).alias("k"), n.cast("long").alias("n"), more.alias("more"))

    rare = F.col("n") < sent_from
    of_words = value(words.where(rare), "v", F.col("n"), F.log10("fail"))
    of_pairs = value(pairs.where(rare), "k", F.lit(None), F.col("over") + F.log10("fail"))
    return staged(of_words.unionByName(of_pairs).unionByName(value(sums, "t", F.lit(None), F.col("more"))), "values")


def build_automaton(words: DataFrame, pairs: DataFrame, triples: DataFrame, least: float) -> dict[str, np.ndarray]:
    """Arcs and failure weights, all as log10, of the n-grams that stand at least so often; the caller has bounded them by SENT_SHARE.

    States: 0 is the empty history, 1 + w the history of word w, 1 + W + p the history of pair p.
    An arc's key is state << ID_BITS | word; arcs are sorted by it.
    """

    def fetch(rows, *columns):
        got = rows.where(F.col("n") >= least).select(*columns).toArrow()
        values = [got[c].to_numpy() for c in columns]
        order = np.argsort(values[0])
        return [v[order] for v in values]

    word, p1, fail1 = fetch(words, "v", "p", "fail")
    key2, a2, b2, p2, fail2 = fetch(pairs, "k", "a", "b", "p", "fail")
    key3, a3, b3, p3 = fetch(triples, "k", "a", "b", "p")
    first, second = flat.lookup(word, a2), flat.lookup(word, b2)
    prefix, suffix = flat.lookup(key2, a3), flat.lookup(key2, b3)
    number = len(word)
    third = second[suffix] if len(suffix) else suffix
    arcs = np.concatenate([((1 + first) << ID_BITS) | second, ((1 + number + prefix) << ID_BITS) | third])
    keyed = np.argsort(arcs)
    return {
        "words": word,
        "pairs": key2,
        "triples": key3,
        "root": np.log10(p1),
        "arcs": arcs[keyed],
        "weights": np.log10(np.concatenate([p2, p3]))[keyed],
        "targets": np.concatenate([1 + number + np.arange(len(key2)), 1 + number + suffix])[keyed],
        "fail": np.concatenate([[0], np.zeros(number, np.int64), 1 + second]),
        "fail_weights": np.concatenate([[0.0], np.log10(fail1), np.log10(fail2)]),
    }


def traverse(automaton: dict, arcs: flat.Places, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Log10 weight of every text without what rare n-grams add; arcs: of the automaton; ids: word ids of the tokens, or -1.

    Long texts are read in lanes of LANE tokens side by side; a lane first walks over the two tokens
    before it, which settles its state, as no history is longer.
    """
    lengths = np.diff(before)
    lanes = -(-lengths // LANE)
    row = np.repeat(np.arange(len(lengths)), lanes)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = before[:-1][row] + turn * LANE
    last = np.minimum(first + LANE, before[1:][row])
    at = np.maximum(first - (ORDER - 1), before[:-1][row])
    order = np.argsort(at - last, kind="stable")
    at, first, last, row = at[order], first[order], last[order], row[order]
    state, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    weights, targets = automaton["weights"], automaton["targets"]
    for step in range(int((last - at).max()) if len(at) else 0):
        active = int(np.searchsorted(at - last, -step, side="left"))
        here = at[:active] + step
        word = ids[here]
        gained = np.zeros(active)
        now, new = state[:active].copy(), np.zeros(active, np.int64)
        new[word >= 0] = 1 + word[word >= 0]
        open_ = np.flatnonzero(now > 0)
        while len(open_):
            found = np.where(word[open_] >= 0, arcs.find((now[open_] << ID_BITS) | np.maximum(word[open_], 0)), -1)
            hit = open_[found >= 0]
            gained[hit] += weights[found[found >= 0]]
            new[hit] = targets[found[found >= 0]]
            now[hit] = -1
            missed = open_[found < 0]
            gained[missed] += automaton["fail_weights"][now[missed]]
            now[missed] = automaton["fail"][now[missed]]
            open_ = missed[now[missed] > 0]
        root = np.flatnonzero((now == 0) & (word >= 0))
        gained[root] += automaton["root"][word[root]]
        total[:active] += np.where(here >= first[:active], gained, 0.0)
        state[:active] = new
    return np.bincount(row, total, minlength=len(lengths)) if len(row) else np.zeros(len(lengths))


def _rare_pairs(sent: flat.Places, maps: tuple, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the pairs that may be kept but are not among those sent."""
    words, good = _pairs(maps[0], tokens)
    at = np.flatnonzero(good)
    keys = _gram_key(words[at], words[at + 1])
    rare = _may_hold(maps[1], keys)
    at, keys = at[rare], keys[rare]
    new = sent.find(keys) < 0
    return at[new], keys[new]


def _rare_triples(sent: flat.Places, maps: tuple, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the triples that may be kept but are not among those sent."""
    _, _, keys, good = _triples(maps[0], maps[1], tokens)
    at = np.flatnonzero(good)
    keys = _gram_key(keys[at], keys[at + 1])
    maybe = _may_hold(maps[2], keys)
    at, keys = at[maybe], keys[maybe]
    new = sent.find(keys) < 0
    return at[new], keys[new]


def _packed_map(flags: np.ndarray) -> bytes:
    return zlib.compress(flags.tobytes(), 1)


def _unpacked_map(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int64)


#: The key comes last: what stands before it is mostly as in the row before, so a shuffled row takes little more than its key.
_TRIPLE_ROWS = "t long, row long, k long"


def _triple_batches(model):
    """Rows for the join with the table of triples: those that the automaton lacks."""

    def run(batches):
        sent, packed = model.value
        sent, maps = flat.Places(sent), tuple(_unpacked_map(x) for x in packed)
        number = TaskContext.get().partitionId() << 40
        for batch in flat.pieces(batches, "text"):
            tokens, before = _tokens(batch)
            places, grams = _rare_triples(sent, maps, tokens)
            row = np.searchsorted(before, places, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(row)), pa.array(number + row), pa.array(grams)], names=["t", "row", "k"])
            number += batch.num_rows

    return run


def _score_batches(model, unseen: float):
    """Rows for the join with the values: the words and pairs that the automaton lacks, and a row of each text's figures.

    unseen: log10 of the smoothed share of a word that does not stand in the training texts.
    """

    def run(batches):
        automaton, packed = model.value
        words, pairs, arcs = (flat.Places(automaton[x]) for x in ("words", "pairs", "arcs"))
        maps = tuple(_unpacked_map(x) for x in packed)
        number = TaskContext.get().partitionId() << 40
        for batch in flat.pieces(batches, "text"):
            tokens, before = _tokens(batch)
            ids = word_ids(words, tokens)
            known = ids >= 0
            base = flat.row_sums(np.where(known, automaton["root"][ids] if len(automaton["root"]) else 0.0, unseen), before)
            score = traverse(automaton, arcs, ids, before) + unseen * flat.row_sums((~known).astype(np.int64), before)
            places, grams = _rare_pairs(pairs, maps, tokens)
            rest = np.flatnonzero(~known)
            row = np.concatenate([np.searchsorted(before, x, side="right") - 1 for x in (rest, places)])
            key = np.concatenate([flat.signed(tokens[rest]), grams])
            # Rows of a text stand together, so that a shuffle compresses them well.
            order = np.argsort(row, kind="stable")
            figures = [batch.column("doc_id"), *(pa.array(x) for x in (np.diff(before), flat.row_sums(known.astype(np.int64), before), base, score))]
            figures = pa.StructArray.from_arrays(figures, names=["doc_id", "n_tokens", "n_known", "base", "score"])
            own = number + np.arange(batch.num_rows)
            for text, rows, keys in ((pa.nulls(len(row), figures.type), number + row[order], key[order]), (figures, own, batch.column("t"))):
                yield pa.RecordBatch.from_arrays([text, pa.array(rows), pa.array(keys)], names=["text", "row", "k"])
            number += batch.num_rows

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, FOLDS) == 0, F.lit(False))


def _model(docs: DataFrame, least_share: float) -> dict:
    """The automaton, the tables and maps of all kept n-grams, and the sizes. docs: text of the training documents."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select("text")
    counts = staged(_count(texts, lambda b: flat.signed(_tokens(b)[0])), "words")
    sizes = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(sizes["n"] or 0), int(sizes["v"])
    least = max(float(LEAST), least_share * total)
    word_map = _kept_map(counts.where(F.col("n") >= least), "v")
    kept_words = send(word_map)

    def pairs_of(batch):
        words, good = _pairs(kept_words.value, _tokens(batch)[0])
        return words[:-1][good], words[1:][good]

    pairs = _count_grams(texts, pairs_of, least, total)
    pair_map = _kept_map(pairs, "k")
    kept_pairs = send(pair_map)

    def triples_of(batch):
        _, _, keys, good = _triples(kept_words.value, kept_pairs.value, _tokens(batch)[0])
        return keys[:-1][good], keys[1:][good]

    triples = _count_grams(texts, triples_of, least, total)
    kept_words.destroy()
    kept_pairs.destroy()
    maps = tuple(_packed_map(x) for x in (word_map, pair_map, _kept_map(triples, "k")))
    sent_from = max(least, SENT_SHARE * total)
    tables = weighted(counts, pairs, triples, total + ADDED * (kinds + 1), sent_from)
    automaton = build_automaton(*tables, sent_from)
    return {"automaton": automaton, "maps": maps, "tables": tables, "counts": counts, "total": total, "kinds": kinds, "sent_from": sent_from}


def train(docs: DataFrame, least_share: float = 0.0) -> tuple[dict, DataFrame, int, int]:
    """The frequent part of the automaton, the counts (v, n) of all words, the number of tokens and of distinct ones.

    docs: text of the training documents. least_share: leaves out n-grams below this share of the tokens.
    """
    model = _model(docs, least_share)
    return model["automaton"], model["counts"], model["total"], model["kinds"]


def _triple_sums(texts: DataFrame, triples: DataFrame, sent) -> DataFrame:
    """(t, more): what the rare triples of each text add to its score; written once."""
    rows = texts.select("text", "t").mapInArrow(_triple_batches(sent), _TRIPLE_ROWS)
    met = rows.join(triples.select("k", "over").hint("shuffle_hash"), "k")
    sums = staged(met.groupBy("t", "row").agg(F.sum("over").alias("more")).groupBy("t").agg(F.max("more").alias("more")), "sums")
    sent.destroy()
    return sums


def score_texts(docs: DataFrame, training: DataFrame, least_share: float = 0.0) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every document."""
    model = _model(training, least_share)
    words, pairs, triples = model["tables"]
    send = docs.sparkSession.sparkContext.broadcast
    # Rows that are equal in doc_id and text have one t, and one sum of triples.
    texts = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("t"))
    sums = _triple_sums(texts, triples.where(F.col("n") < model["sent_from"]), send((model["automaton"]["triples"], model["maps"])))
    values = rare_values(words, pairs, sums, model["sent_from"])
    discard(sums, model["counts"], *model["tables"])
    whole = float(np.log10(model["total"] + ADDED * (model["kinds"] + 1)))
    figures = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},n_tokens:long,n_known:long,base:double,score:double>"
    sent = send((model["automaton"], model["maps"][:2]))
    rows = texts.mapInArrow(_score_batches(sent, float(np.log10(ADDED)) - whole), f"text {figures}, row long, k long")
    seen = F.log10(F.col("n") + ADDED) - F.log10(F.lit(ADDED))  # over a word that was not seen
    met = rows.join(values.hint("shuffle_hash"), "k", "left").withColumns({"p": seen, "known": F.col("n").isNotNull().cast("long")})
    of_text = [F.max(f"text.{c}").alias(c) for c in ("doc_id", "n_tokens", "n_known", "base", "score")]
    met = met.groupBy("row").agg(*of_text, *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("p", "more", "known")))
    return met.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"),
        F.lit(model["total"]).cast("long").alias("train_tokens"), (F.col("base") + F.col("p")).alias("base_score"), (F.col("score") + F.col("p") + F.col("more")).alias("score"),
    )
