"""Language identification by segmentation-marginalised unigram piece models.

The pieces are a fixed public vocabulary. Each language has a probability per piece, and the likelihood of
a word is the sum over all ways to cut it into pieces, computed by a forward pass over its bytes. A text's
likelihood is the product over its words; the language with the highest one is predicted. Single bytes are
pieces too, so every word can be cut.

Piece probabilities are fitted by expectation-maximisation (forward-backward counts) on the words of about
SAMPLE_DOCS labeled documents per language, chosen by a hash of doc_id, with the TRAIN_WORDS most frequent
words of each language; that bounded word list is all that reaches the driver. Whole runs of letters are
learned from, cut as they are for scoring. Scoring reads every whole
text, each distinct word of a batch once.

Null text or a text without a letter: `und` with score 0. No labeled documents: `und` for all. Empty
table: empty result. A tie goes to the language first by name. Rows are handled one by one, so repeated
rows and doc_ids give a row each; rows with a null language are predicted but not learned from. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import flat
from quern.llm.columns import remainder, whole_text, words

#: Folder of the public tokenizers and the vocabulary file used; both are parameters.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLE_DOCS = 1000
TRAIN_WORDS = 30_000
ROUNDS = 4
#: Pieces of more bytes are not used. Longer runs of letters, as in scripts without spaces, are words of about
#: WORD_STEP bytes each, cut between characters, so that WORD_MOST bytes hold one and the space before it.
PIECE_MOST = 12
WORD_MOST = 48
WORD_STEP = WORD_MOST - 4
FOLDS = 3
UND = "und"
#: Bytes of text looked at together: each distinct word of them is scored once.
PIECE_BYTES = 4 << 20
#: Words that a text's evidence counts as at most, for the score.
EVIDENCE = 4.0

_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def load_pieces(path: str = VOCABULARY) -> list[bytes]:
    """The vocabulary's pieces as bytes, in lower case ASCII, a space for a word's beginning; then all bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        piece = bytes(b + 32 if 65 <= b < 91 else b for b in piece)
        if 1 < len(piece) <= PIECE_MOST and (set(piece[1:]) - {32}) and 32 not in piece[1:] and not any(_NO_LETTER[b] for b in piece[1:]):
            found.add(piece)
    return [bytes([b]) for b in range(256)] + sorted(found)


def piece_table(pieces: list[bytes]) -> dict[str, np.ndarray]:
    """The pieces by their hash: slots with the hash to compare and the piece's number, and those whose slot was taken."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces])
    ends = np.cumsum(lengths)
    keys = flat.span_hashes(data, ends - lengths, ends)
    bits = max(16, int(np.ceil(np.log2(len(pieces) * 16))))
    slots = (keys >> np.uint64(64 - bits)).astype(np.int64)
    table = {"keys": np.zeros(1 << bits, np.uint64), "ids": np.full(1 << bits, -1, np.int32), "number": np.array(len(pieces)), "bits": np.array(bits)}
    _, first = np.unique(slots, return_index=True)
    table["keys"][slots[first]], table["ids"][slots[first]] = keys[first], first
    rest = np.setdiff1d(np.arange(len(pieces)), first)
    rest = rest[np.argsort(keys[rest])]
    return table | {"rest_keys": keys[rest], "rest_ids": rest.astype(np.int32)}


def find_pieces(table: dict, hashes: np.ndarray) -> np.ndarray:
    """The number of the piece with each hash, or -1."""
    slots = (hashes >> np.uint64(64 - int(table["bits"]))).astype(np.int64)
    taken = table["ids"][slots]
    ids = np.where(table["keys"][slots] == hashes, taken, -1)
    if len(table["rest_keys"]):
        missing = np.flatnonzero((ids < 0) & (taken >= 0))
        at = flat.lookup(table["rest_keys"], hashes[missing])
        ids[missing] = np.where(at >= 0, table["rest_ids"][at], -1)
    return ids


def lattice(pieces: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Words sorted from long to short, and for each piece length the piece that ends at each byte.

    Returns (order, lengths, ids): ids[l][pos - 1] are the pieces of l bytes that end after byte pos, for the
    words longer than pos - 1 in that order, or -1.
    """
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    table = []
    for pos in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
        active = int(np.searchsorted(-lengths, -pos, side="right"))
        at = starts[:active] + pos
        table.append([find_pieces(pieces, flat.span_hashes_at(data, at - size, size)) if size <= pos else None for size in range(1, PIECE_MOST + 1)])
    return order, lengths, table


def forward(table, lengths: np.ndarray, logless: np.ndarray) -> list[np.ndarray]:
    """alpha[pos][word, language]: the sum over all cuts of the first pos bytes. logless: pieces x languages."""
    alpha = [np.ones((len(lengths), logless.shape[1]))]
    for pos, by_size in enumerate(table, 1):
        active = len(by_size[0])
        total = np.zeros((active, logless.shape[1]))
        for size, ids in enumerate(by_size, 1):
            if ids is None:
                break
            known = np.flatnonzero(ids >= 0)
            if len(known):
                total[known] += alpha[pos - size][known] * logless[ids[known]]
        alpha.append(total)
    return alpha


def word_log_likelihoods(pieces: dict, probabilities: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log of the sum over all cuts, for every word and language."""
    order, lengths, table = lattice(pieces, data, starts, ends)
    alpha = forward(table, lengths, probabilities)
    out = np.zeros((len(starts), probabilities.shape[1]))
    for pos in range(1, len(alpha)):
        here = np.flatnonzero(lengths[: len(alpha[pos])] == pos)
        out[order[here]] = np.log(np.maximum(alpha[pos][here], 1e-300))
    return out


def expected_counts(pieces: dict, p: np.ndarray, weights: np.ndarray, data, starts, ends) -> np.ndarray:
    """How often each piece is used in expectation, for one language. weights: how often each word stands."""
    order, lengths, table = lattice(pieces, data, starts, ends)
    if not len(lengths):
        return np.zeros(int(pieces["number"]))
    alpha = [a[:, 0] for a in forward(table, lengths, p[:, None])]
    whole = np.zeros(len(lengths))
    for pos in range(1, len(alpha)):
        here = np.flatnonzero(lengths[: len(alpha[pos])] == pos)
        whole[here] = alpha[pos][here]
    beta = [np.zeros(len(lengths)) for _ in range(len(alpha))]
    for pos in range(1, len(alpha)):
        beta[pos][lengths == pos] = 1.0
    out = np.zeros(int(pieces["number"]))
    share = weights[order] / np.maximum(whole, 1e-300)
    for pos in range(len(table), 0, -1):
        for size, ids in enumerate(table[pos - 1], 1):
            if ids is None:
                break
            known = np.flatnonzero(ids >= 0)
            if not len(known):
                continue
            after = beta[pos][known] * p[ids[known]]
            beta[pos - size][known] += after
            out += np.bincount(ids[known], alpha[pos - size][known] * after * share[known], minlength=int(pieces["number"]))
    return out


def cut_run(word: bytes) -> list[bytes]:
    """A run of letters as the words that it is read as; cut_words does the same to many."""
    marks = list(range(WORD_STEP, len(word), WORD_STEP))
    for i, at in enumerate(marks):
        while word[at] & 0xC0 == 0x80:
            at -= 1
        marks[i] = at
    return [word[a:b] for a, b in zip([0, *marks], [*marks, len(word)])]


def _word_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [b" " + word for word in words]
    ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    return flat.lower_ascii(np.frombuffer(b"".join(parts), np.uint8)), ends - np.array([len(p) for p in parts], np.int64), ends


def fit(word_counts: dict[str, list[tuple[str, int]]], pieces: dict, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages by name and their piece probabilities (pieces x languages)."""
    languages = sorted(word_counts)
    out = np.zeros((int(pieces["number"]), len(languages)))
    for column, language in enumerate(languages):
        listed = sorted(word_counts[language])
        read = [(part, n) for word, n in listed for part in cut_run(word.encode())]
        data, starts, ends = _word_bytes([w for w, _ in read])
        weights = np.array([n for _, n in read], float)
        p = np.full(int(pieces["number"]), 1.0 / int(pieces["number"]))
        for _ in range(rounds):
            counts = expected_counts(pieces, p, weights, data, starts, ends) + 0.01
            p = counts / counts.sum()
        out[:, column] = p
    return languages, out


def train(docs: DataFrame, pieces: dict, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray] | None:
    """docs: doc_id, text, lang; rows that may be learned from."""
    usable = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)).cast("int")
    most = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(1_000_000 * min(1.0, sample_docs / n)) + 1)])
    drawn = usable.where(part < most[F.col("lang")])
    plain = F.regexp_replace(F.lower(whole_text()), r"[\x00-\x60\x7B-\x7F]+", " ")
    counts = drawn.select("lang", F.explode(words(plain)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "w")
    kept = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= TRAIN_WORDS)
    by_language: dict[str, list] = {}
    for r in kept.select("lang", "w", "n").collect():
        by_language.setdefault(r["lang"], []).append((r["w"], r["n"]))
    return fit(by_language, pieces) if by_language else None


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray):
    """Runs of letters of more than WORD_STEP bytes as several words, cut between characters."""
    number = -(-(ends - starts) // WORD_STEP)
    if not len(starts) or number.max() == 1:
        return starts, ends, before
    owner = np.repeat(np.arange(len(starts)), number)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    new = starts[owner] + turn * WORD_STEP
    for _ in range(3):
        new -= (turn > 0) & (data[new] & 0xC0 == 0x80)
    stop = np.append(new[1:], 0)
    last = np.append(owner[1:] != owner[:-1], True)
    stop[last] = ends[owner[last]]
    return new, stop, np.concatenate([[0], np.cumsum(number)])[before]


def text_likelihoods(pieces: dict, probabilities: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language, and its number of words."""
    data = flat.lower_ascii(data)
    starts, ends, before = flat.word_spans(data, bounds, _NO_LETTER)
    starts, ends, before = cut_words(data, starts, ends, before)
    hashes = flat.span_hashes(data, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    # The distinct words, each after a space.
    lengths = ends[first] - starts[first]
    new_ends = np.cumsum(lengths + 1)
    new_starts = new_ends - lengths - 1
    held = np.full(int(new_ends[-1]) if len(new_ends) else 0, 32, np.uint8)
    inside = np.ones(len(held), bool)
    inside[new_starts] = False
    source = np.repeat(starts[first] - new_starts - 1, lengths) + np.flatnonzero(inside)
    held[inside] = data[source]
    per_word = word_log_likelihoods(pieces, probabilities, held, new_starts, new_ends)
    sums = np.stack([flat.row_sums(per_word[which, c], before) for c in range(probabilities.shape[1])], axis=1) if len(starts) else np.zeros((len(bounds) - 1, probabilities.shape[1]))
    return sums, np.diff(before)


def predict_batches(pieces, languages: list[str], probabilities, text: str = "text"):
    """For mapInArrow: doc_id with the most likely language and its score. pieces, probabilities: broadcasts."""

    def run(batches):
        for batch in flat.pieces(batches, text, PIECE_BYTES):
            sums, number = text_likelihoods(pieces.value, probabilities.value, *flat.column(batch.column(text)))
            best = sums.argmax(axis=1)
            # Evidence as a mean per word, so that long texts do not all score 1.
            mean = EVIDENCE * (sums - sums.max(axis=1, keepdims=True)) / np.maximum(number, 1)[:, None]
            score = 1 / np.exp(mean).sum(axis=1)
            names = np.array(languages, object)[best]
            names[number == 0] = UND
            score[number == 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lettered"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lettered", "lang_pred", "score"])

    return run


def held_out(key: Column) -> Column:
    return F.coalesce(remainder(key, FOLDS) == 1, F.lit(False))


def identify(docs: DataFrame, vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; held-out rows' languages are not read."""
    spark = docs.sparkSession
    pieces = piece_table(load_pieces(vocabulary))
    model = train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), pieces, sample_docs)
    rows = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    fold = held_out(F.col("doc_id")).alias("held_out")
    if model is None:
        return rows.select("doc_id", fold, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, probabilities = model
    # Both are bounded by the vocabulary times the number of languages.
    run = predict_batches(spark.sparkContext.broadcast(pieces), languages, spark.sparkContext.broadcast(probabilities))
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, lettered boolean, lang_pred string, score double")
    sure = F.col("lettered")
    return found.select("doc_id", fold, F.when(sure, F.col("lang_pred")).otherwise(UND).alias("lang_pred"), F.when(sure, F.col("score")).otherwise(0.0).alias("score"))


