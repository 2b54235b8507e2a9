"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Base spans (emails, IP addresses, card and phone numbers that pass their checks) always stay. Wider
patterns propose further spans: secrets, national phone numbers, written-out emails and card numbers.
Four labelers vote for, against or not at all on every span: a strict pattern with its checks, a gazetteer
of known parts, a gazetteer of words before the span, and the span's make-up. Expectation-maximisation
over the counted vote patterns estimates how often each labeler votes how for true and for false spans
(no labeled data is used). The posteriors then train the final classifier, a naive Bayes model over
discrete traits of the span, which accepts a proposed span at ACCEPT or more.

Vote patterns and traits have a fixed number of values, so the tables that are counted, and the model,
are bounded whatever the corpus; counts cover all spans of all documents.

Null text: as an empty text, with no spans. Empty table: empty result. A corpus without proposals: the
classifier has nothing to accept. Rows are handled one by one, so repeated rows and doc_ids give a row
each. A span of equal kind and place is listed once; a proposal that overlaps a base span or an earlier
proposed kind's span is dropped. The work on a text with many matches grows with their number, not its
square. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.columns import let, whole_text
from quern.session import staged

#: The kinds in the order in which spans of one place are listed.
KINDS = ["email", "ip", "card", "phone", "secret"]
#: The base patterns, written so that a failed try is not repeated inside the same run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider patterns of the method's proposals.
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,64}){1,5}"
WIDE_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SECRET_STARTS = r"AKIA|ASIA|AIza|gh[po]_|xox[bp]-|sk-"
SECRET_WORDS = r"(?i:password|passwd|pwd|secret|token|api_key|api-key|apikey)"
SECRET = (
    rf"(?<![A-Za-z0-9])(?:{SECRET_STARTS})[A-Za-z0-9_-]{{12,}}+"
    rf"|(?<={SECRET_WORDS} ?[=:] ?[\"']?)[^\s\"',;]{{6,}}+"
)
#: What a text must hold for a secret.
SECRET_SIGN = f"{SECRET_STARTS}|{SECRET_WORDS}"
#: The gazetteers.
DOMAIN_ENDS = "com|org|net|edu|gov|io|info|de|fr|es|uk|eu|it|nl|ch|at|us|ca|au"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|39|41|43|44|45|46|47|48|49|52|55|61|81|82|86|91"
CARD_STARTS = r"4|5[1-5]|2[2-7]|3[47]|6011|65"
CONTEXT = r"(?i)(?:mail|contact|write|phone|tel|call|mobile|fax|card|visa|credit|payment|host|server|address|login|user|password|key|token|secret)\W{0,3}$"
CONTEXT_CHARS = 16
#: Matches of a text whose places are summed up in one run.
RUN = 256
ACCEPT = 0.5
ROUNDS = 12
VOTES = ("strict", "known", "context", "shape")
TRAITS = ("kind", "length", "digits", "classes", "before", "after")


def _starts(both: Column) -> Column:
    """Where each match starts, from (g, m) gaps and matches: sums within runs of RUN matches, then over the runs.

    An array that grows by a concat is copied each time, so none here grows beyond RUN or a RUN-th of the matches.
    """
    none = F.array().cast("array<int>")
    length = lambda x: F.char_length(x["g"]) + F.char_length(x["m"])

    def running(items: Column, lengths, at: Column, place) -> Column:
        first = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(items, first, lambda a, x: F.struct((a["at"] + lengths(x)).alias("at"), F.concat(a["out"], F.array(place(a["at"], x))).alias("out")), lambda a: a["out"])

    def of_runs(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + length(x)))
        before = running(sums, lambda n: n, F.lit(0), lambda at, n: at)
        return let(before, lambda b: F.flatten(F.transform(runs, lambda r, i: running(r, length, F.get(b, i), lambda at, x: at + F.char_length(x["g"])))))

    cuts = F.sequence(F.lit(0), F.floor((F.size(both) - 1) / RUN).cast("int"))
    return F.when(F.size(both) == 0, none).otherwise(let(F.transform(cuts, lambda k: F.slice(both, k * RUN + 1, RUN)), of_runs))


def spans(text: Column, pattern: str) -> Column:
    """All leftmost matches as struct(s, e, m, before, after).

    s and e: places in code points, end exclusive; m: the match; before: up to CONTEXT_CHARS characters in front of
    it; after: the next character. These come from the neighbouring gaps and matches, as a cut from the whole
    text would read it from its start for every match.
    """
    tail = lambda c: F.substring(c, -CONTEXT_CHARS, CONTEXT_CHARS)

    def listed(both: Column, starts: Column, last: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            s = F.get(starts, i)
            near = F.transform(F.slice(both, F.greatest(i - CONTEXT_CHARS, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_CHARS))), lambda y: tail(F.concat(tail(y["g"]), y["m"])))
            before = F.when(F.char_length(x["g"]) >= CONTEXT_CHARS, tail(x["g"])).otherwise(tail(F.concat(F.array_join(near, ""), x["g"])))
            following = F.get(both, i + 1)
            after = F.coalesce(F.concat(F.substring(following["g"], 1, 1), F.substring(following["m"], 1, 1)), last)
            return F.struct(s.alias("s"), (s + F.char_length(x["m"])).alias("e"), x["m"].alias("m"), before.alias("before"), F.substring(after, 1, 1).alias("after"))

        return F.transform(both, one)

    def placed(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        both = F.transform(found, lambda m, i: F.struct(F.get(gaps, i).alias("g"), m.alias("m")))
        last = F.substring(F.element_at(gaps, -1), 1, 1)
        return let(both, lambda b: let(F.struct(_starts(b).alias("starts"), last.alias("last")), lambda x: listed(b, x["starts"], x["last"])))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a run of digits passes the Luhn check."""

    def add(a: Column, x: Column) -> Column:
        return a + x

    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))),
    )
    return F.coalesce(F.aggregate(each, F.lit(0), add) % 10 == 0, F.lit(False))


def _few_digits(m: Column, least: int, most: int) -> Column:
    return F.char_length(_digits(m)).between(least, most)


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", "").rlike("^([0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))


def _kind(found: Column, kind: str, keep=None) -> Column:
    good = found if keep is None else F.filter(found, lambda x: keep(x["m"]))
    return F.transform(good, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), *[x[c].alias(c) for c in ("s", "e", "m", "before", "after")]))


_SPANS = "array<struct<k:int,s:int,e:int,m:string,before:string,after:string>>"


def _if(test: Column, value: Column) -> Column:
    return F.when(test, value).otherwise(F.array().cast(_SPANS))


def base_spans(text: Column) -> Column:
    """The spans of the base patterns that pass their checks, by start, then kind."""
    digit = text.rlike("[0-9]")
    card = lambda m: _few_digits(m, 12, 19) & luhn(_digits(m))
    return F.array_sort(
        F.concat(
            _if(text.contains("@"), _kind(spans(text, EMAIL), "email")),
            _if(text.rlike(r"[0-9]\.[0-9]"), _kind(spans(text, IP), "ip", _octets)),
            _if(digit & text.rlike("[0-9](?:[ -]?[0-9]){11}"), _kind(spans(text, CARD), "card", card)),
            _if(text.contains("+"), _kind(spans(text, PHONE), "phone", lambda m: _few_digits(m, 9, 15))),
        ),
        lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"]),
    )


def _overlaps(x: Column, others: Column) -> Column:
    """Whether x overlaps one of others, which are by start and do not overlap each other; found by halving.

    The last one that starts before x ends is the only one that has to be looked at.
    """
    steps = F.transform(F.sequence(F.length(F.bin(F.size(others))).cast("int") - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))
    at = F.aggregate(steps, F.lit(0), lambda a, n: F.when(F.coalesce(F.get(others, a + n - 1)["s"] < x["e"], F.lit(False)), a + n).otherwise(a))
    return F.coalesce(F.get(others, at - 1)["e"] > x["s"], F.lit(False))


def proposed_spans(text: Column, base: Column) -> Column:
    """Further spans for the classifier, none of them overlapping a base span or one proposed for an earlier kind."""
    digit = text.rlike("[0-9]")
    wide = [
        _if(text.rlike(r"(?i)[\[(]at[\])]"), _kind(spans(text, WIDE_EMAIL), "email")),
        _if(digit & text.rlike("[0-9](?:[ -]?[0-9]){11}"), _kind(spans(text, CARD), "card", lambda m: _few_digits(m, 12, 19))),
        _if(digit, _kind(spans(text, WIDE_PHONE), "phone")),
        _if(text.rlike(SECRET_SIGN), _kind(spans(text, SECRET), "secret")),
    ]
    of_kind = lambda k: F.filter(base, lambda b: b["k"] == k)
    base_kinds = [of_kind(k) for k in range(KINDS.index("secret"))]

    def apart(spans_: Column, rows: Column, lists: list[str]) -> Column:
        return F.filter(spans_, lambda x: ~reduce(lambda found, name: found | _overlaps(x, rows[name]), lists, F.lit(False)))

    def kept(rows: Column) -> Column:
        """What overlaps no base span of any kind."""
        names = [f"b{k}" for k in range(len(base_kinds))]
        return F.struct(*[apart(rows[f"w{i}"], rows, names).alias(f"w{i}") for i in range(len(wide))])

    def first(rows: Column) -> Column:
        return F.concat(*[apart(rows[f"w{i}"], rows, [f"w{j}" for j in range(i)]) for i in range(len(wide))])

    every = F.struct(*[b.alias(f"b{k}") for k, b in enumerate(base_kinds)], *[w.alias(f"w{i}") for i, w in enumerate(wide)])
    return let(let(every, kept), first)


def _vote(test: Column) -> Column:
    """1 for, 0 against."""
    return F.coalesce(test, F.lit(False)).cast("int")


def _by_kind(kind: Column, **columns: Column) -> Column:
    out = F.lit(-1)
    for name, value in columns.items():
        out = F.when(kind == KINDS.index(name), value).otherwise(out)
    return out


def labeled(x: Column) -> Column:
    """A span with its votes (1 for, 0 against, -1 none) and its traits."""
    k, m, before, next_char = x["k"], x["m"], x["before"], x["after"]
    digits = _digits(m)
    many = F.char_length(digits)
    letters = m.rlike("[A-Za-z]")
    strict = _by_kind(
        k,
        email=_vote(m.rlike(r"^[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")),
        ip=_vote(_octets(m)),
        card=_vote(luhn(digits)),
        phone=_vote(m.rlike(r"^(\+|\()") & many.between(9, 15)),
        secret=_vote(m.rlike("(AKIA|ASIA)[A-Z0-9]{16}$|[A-Za-z0-9+/_-]{12}$") & m.rlike("[0-9]")),
    )
    known = _by_kind(
        k,
        email=_vote(m.rlike(rf"(?i)({DOMAIN_ENDS})$")),
        ip=_vote(~m.rlike(r"^(0|10|127|169\.254|192\.168|2[2-5][0-9])\.")),
        card=_vote(digits.rlike(f"^({CARD_STARTS})")),
        phone=F.when(m.startswith("+"), _vote(digits.rlike(f"^({CALLING_CODES})"))).otherwise(F.lit(-1)),
        secret=F.when(m.rlike(f"^({SECRET_STARTS})"), F.lit(1)).otherwise(F.lit(-1)),
    )
    context = F.when(before.rlike(CONTEXT), F.lit(1)).when(before.rlike(r"(?i)(?:version|release|no|nr|page|figure)\W{0,3}$"), F.lit(0)).otherwise(F.lit(-1))
    variety = F.size(F.array_distinct(F.split(digits, "")))
    shape = F.when(k == KINDS.index("email"), _vote(F.char_length(m) >= 6)).when(k == KINDS.index("secret"), _vote(m.rlike("[0-9]") & letters)).otherwise(_vote(variety >= 4))
    kinds = m.rlike("[a-z]").cast("int") + m.rlike("[A-Z]").cast("int") + m.rlike("[0-9]").cast("int") + m.rlike("[^A-Za-z0-9]").cast("int")
    traits = {
        "kind": k,
        "length": F.least(F.floor(F.char_length(m) / 6), F.lit(6)).cast("int"),
        "digits": F.least(F.floor(many / 4), F.lit(5)).cast("int"),
        "classes": kinds,
        "before": F.when(before == "", F.lit(0)).when(before.rlike(r"\s$"), F.lit(1)).otherwise(F.lit(2)),
        "after": F.when(next_char == "", F.lit(0)).when(next_char.rlike(r"[\s.,;!?]"), F.lit(1)).otherwise(F.lit(2)),
    }
    votes = {"strict": strict, "known": known, "context": context, "shape": shape}
    return F.struct(k.alias("k"), x["s"].alias("s"), x["e"].alias("e"), *[v.alias(n) for n, v in votes.items()], *[v.cast("int").alias(f"t_{n}") for n, v in traits.items()])


def label_reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """EM over (k, votes, n): the share of true spans per kind, and how often each labeler votes for true and false ones.

    A labeler that does not vote says nothing, and every labeler is taken to be better than chance, which
    keeps the two classes from changing places. Each round is one aggregate over the pattern table, which
    has at most 5 * 3 ** 4 rows.
    """
    model = {"shares": {k: 0.5 for k in range(len(KINDS))}, "odds": {v: (0.8, 0.2) for v in VOTES}}
    for _ in range(rounds):
        p = posterior(model)
        sums = [F.sum(F.col("n")).alias("n")]
        for k in model["shares"]:
            here = (F.col("k") == k).cast("double")
            sums += [F.sum(F.col("n") * p * here).alias(f"k{k}p"), F.sum(F.col("n") * here).alias(f"k{k}n")]
        for v in VOTES:
            for name, weight in (("t", p), ("f", 1 - p)):
                voted = F.col("n") * weight
                sums.append(F.sum(voted * (F.col(v) == 1).cast("double")).alias(f"{v}_{name}"))
                sums.append(F.sum(voted * (F.col(v) >= 0).cast("double")).alias(f"{v}_{name}n"))
        got = patterns.agg(*sums).first()
        if not got["n"]:
            break
        share = {k: (got[f"k{k}p"] + 1) / (got[f"k{k}n"] + 2) for k in model["shares"]}
        odds = {}
        for v in VOTES:
            true = (got[f"{v}_t"] + 4) / (got[f"{v}_tn"] + 5)
            false = (got[f"{v}_f"] + 1) / (got[f"{v}_fn"] + 5)
            odds[v] = (min(max(true, 0.55), 0.99), min(max(false, 0.01), 0.45))
        model = {"shares": share, "odds": odds}
    return model


def posterior(model: dict) -> Column:
    """The chance that a span is true, given its kind and votes."""
    true, false = F.lit(0.5), F.lit(0.5)
    for k, share in model["shares"].items():
        true = F.when(F.col("k") == k, F.lit(share)).otherwise(true)
        false = F.when(F.col("k") == k, F.lit(1 - share)).otherwise(false)
    for v, (t, f) in model["odds"].items():
        true = true * F.when(F.col(v) == 1, F.lit(t)).when(F.col(v) == 0, F.lit(1 - t)).otherwise(F.lit(1.0))
        false = false * F.when(F.col(v) == 1, F.lit(f)).when(F.col(v) == 0, F.lit(1 - f)).otherwise(F.lit(1.0))
    return true / (true + false)


def train_classifier(spans_: DataFrame, model: dict) -> DataFrame:
    """One row `weights`: map from trait and value to log odds, learned from the EM posteriors."""
    p = posterior(model)
    traits = F.array(F.lit("all"), *[F.concat(F.lit(f"{t}:"), F.col("k"), F.lit(":"), F.col(f"t_{t}")) for t in TRAITS])
    each = spans_.select(p.alias("p"), F.explode(traits).alias("trait"))
    sums = each.groupBy("trait").agg(F.sum("p").alias("t"), F.sum(1 - F.col("p")).alias("f"))
    listed = sums.agg(F.collect_list(F.struct("trait", "t", "f")).alias("x"))
    pairs = listed.select("x", F.filter("x", lambda s: s["trait"] == "all")[0].alias("a"))
    log_odds = lambda s, a: F.log((s["t"] + 1) / (a["t"] + 2)) - F.log((s["f"] + 1) / (a["f"] + 2))
    entries = F.transform("x", lambda s: F.struct(s["trait"].alias("trait"), F.when(s["trait"] == "all", F.log((s["t"] + 1) / (s["f"] + 1))).otherwise(log_odds(s, F.col("a"))).alias("w")))
    return pairs.select(F.map_from_entries(entries).alias("weights"))


def _score(x: Column, weights: Column) -> Column:
    keys = [F.lit("all")] + [F.concat(F.lit(f"{t}:"), x["k"], F.lit(":"), x[f"t_{t}"]) for t in TRAITS]
    total = F.lit(0.0)
    for key in keys:
        total = total + F.coalesce(F.element_at(weights, key), F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """doc_id with base (all base spans) and found (base and accepted spans), each by start, then kind.

    docs: doc_id, text. The texts are read once; what later steps read is the staged spans.
    """
    body = docs.select("doc_id", whole_text().alias("_text"))
    both = let(
        base_spans(F.col("_text")),
        lambda base: F.struct(
            F.transform(base, labeled).alias("base"),
            F.transform(proposed_spans(F.col("_text"), base), labeled).alias("more"),
        ),
    )
    maybe = F.col("_text").rlike(rf"[0-9@]|(?i:[\[(]at[\])])|{SECRET_SIGN}")
    rows = staged(body.select("doc_id", F.when(maybe, both).alias("_s")).select("doc_id", "_s.base", "_s.more"), "spans")
    each = rows.where("size(base) + size(more) > 0").select(F.explode(F.concat("base", "more")).alias("x")).select("x.*")
    patterns = staged(each.groupBy("k", *VOTES).agg(F.count("*").alias("n")), "patterns")
    model = label_reliabilities(patterns)
    held = rows.withColumn("_weights", train_classifier(each, model).scalar())
    order = lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(a["k"] - b["k"])
    place = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    base = F.coalesce(F.transform("base", place), none)
    more = F.coalesce(F.transform(F.filter("more", lambda x: _score(x, F.col("_weights")) >= accept), place), none)
    return held.select("doc_id", base.alias("base"), F.array_sort(F.concat(base, more), order).alias("found"))


def span_text(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def kind_count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["k"] == KINDS.index(kind))).cast("long")
