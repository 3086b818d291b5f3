"""Personal data by weak supervision, in DataFrame operations only.

Base spans: email, ip, card and phone by pattern and check digits; they always stay. Beyond them, wide patterns
propose candidates (secrets, national phone numbers, spelled-out addresses, identity numbers) and four labelers
vote on each: a strict pattern, a gazetteer of words among the last ones before it, the punctuation of its context, and
its mix of characters; a vote is yes, no or none. Spark counts how often each pattern of votes occurs over all
documents: at most kinds x 81 numbers, whatever the corpus. From these counts expectation-maximisation estimates how
reliable each labeler is, and how likely each pattern of votes makes personal data.

The final classifier doesn't see the votes. It is a logistic regression on features of the span (its length and its
shares and kinds of characters) and of its context (the word and the character before it), fitted to the estimated
probabilities of `SAMPLE` candidates (those of the least hashes; a bound for the driver's fit only). Candidates that the
labelers can't settle are thus decided by what else they have in common with others. A candidate that reaches `accept`
and overlaps no span before it is added.

Limits of the wide patterns: a spelled-out address has at most 64 characters before the "at", 63 in each part, and five
dots; the context of a candidate is the `CONTEXT` characters before it, no further than the start of the match before.

Positions are code points, ends exclusive. A null text is empty. Rows are judged each by its own text, whatever their
doc_id; an empty table gives no rows. Columns other than doc_id and text are not read. `redacted` works row by row: null and
repeated doc_ids are rows like others, extra columns of any name stay, and a null text stays null.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, only_columns, place_of, written

KINDS = ("email", "ip", "card", "phone", "secret", "address", "identity")
#: The patterns of the contract, written so that they can't backtrack (what follows a possessive part
#: can't begin with a character of it) and so that a run of characters is entered at its start alone.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "secret": r"(?=[A-Za-z0-9_/+-])(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+=*+",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "address": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
STRICT = {
    "secret": r"^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{16,128})$",
    "phone": r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$",
    "address": r"\b(?i:com|org|net|edu|gov|info|io)$",
    "identity": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
}
#: The gazetteer: words that stand before personal data, and words that stand before other codes and numbers.
FOR = (
    "password passwd passphrase pwd pin token tokens secret secrets key keys apikey bearer credential credentials auth authorization access login "
    "tel telephone phone call cell mobile fax whatsapp sms dial mail email contact reach write ssn social security identity passport licence license taxpayer"
).split()
AGAINST = "version release build isbn issn doi price total page pages line lines chapter section figure table commit revision sha1 sha256 md5 checksum digest etag http https www url href img src".split()
VOTES = 4
CONTEXT = 24
#: Candidates that the final classifier is fitted on, at most.
SAMPLE = 20_000
#: Slots for the features of one kind, and for the word before a span among them.
SLOTS, WORDS = 64, 16
#: Terms that are added at once where sums over a list are cumulated.
STEP = 64
#: Code points in a block of a text that is put together anew.
BLOCK = 4096


def let(value, body):
    """body(value), with value computed once for a row; in a lambda, an expression is computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def cumulated(x, how: str = "sum"):
    """array<int>: the sum (or the greatest, 0 at least) of the elements before each one of array<int> x, and of all.

    STEP operations for each element; a list is never copied whole.
    """
    join = (lambda a, v: a + v) if how == "sum" else (lambda a, v: F.greatest(a, v))
    of = lambda part: F.aggregate(part, F.lit(0), join)
    last = lambda x: F.floor(F.size(x) / STEP).cast("int")

    def each(x, base):
        def own(i):
            c = F.floor(i / STEP).cast("int")
            return join(F.get(base, c), of(F.slice(x, c * STEP + 1, i - c * STEP)))

        return F.transform(F.sequence(F.lit(0), F.size(x)), own)

    blocks = lambda x: F.transform(F.sequence(F.lit(0), last(x)), lambda c: of(F.slice(x, c * STEP + 1, F.lit(STEP))))
    bases = lambda x, b: F.transform(F.sequence(F.lit(0), last(x)), lambda c: of(F.slice(b, F.lit(1), c)))
    return let(x, lambda x: let(blocks(x), lambda b: let(bases(x, b), lambda base: each(x, base))))


def find_all(text, pattern: str, context: bool = False):
    """array<struct<start, end, found(, left)>> of leftmost, non-overlapping matches, in code points.

    left: up to CONTEXT characters before the match, from the one before on.
    """
    fields = "start:int,end:int,found:string" + ",left:string" * context

    def match(m, i, at, found, gaps):
        parts = [F.get(at, 2 * i + 1).alias("start"), F.get(at, 2 * i + 2).alias("end"), m.alias("found")]
        if context:
            left = F.concat(F.when(i > 0, F.get(found, i - 1)).otherwise(F.lit("")), F.get(gaps, i))
            parts.append(F.right(left, F.lit(CONTEXT)).alias("left"))
        return F.struct(*parts)

    def walk(found, gaps):
        lengths = F.flatten(F.transform(found, lambda m, i: F.array(F.char_length(F.get(gaps, i)), F.char_length(m))))
        return let(cumulated(lengths), lambda at: F.transform(found, lambda m, i: match(m, i, at, found, gaps)))

    none = F.array().cast(f"array<struct<{fields}>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: walk(found, gaps))).otherwise(none))


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: str, m):
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?!$)|$)){4}$")
    if kind == "card":
        return F.char_length(_digits(m)).between(14, 19) & F.call_function("luhn_check", F.when(F.char_length(_digits(m)) <= 19, _digits(m)).otherwise("1"))
    if kind == "phone":
        return F.char_length(_digits(m)).between(10, 15)
    return F.lit(True)


def _kept(found, k: int, kind: str):
    return F.transform(F.filter(found, lambda x: _holds(kind, x["found"])), lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))


def base_spans(text):
    """array<struct<start, kind index, end>>, sorted."""
    out = []
    for k, kind in enumerate(("email", "ip", "card", "phone")):
        found = find_all(text, BASE[kind])
        if kind in ("email", "phone"):
            found = F.when(F.contains(text, F.lit("@" if kind == "email" else "+")), found).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))
        out.append(_kept(found, k, kind))
    return F.array_sort(F.concat(*out))


def _vote(yes, no):
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _among(before, words: list[str]):
    """Whether one of the last words is among these."""
    return F.arrays_overlap(before, F.array(*map(F.lit, words)))


def _features(kind: str, m, left, before):
    """Slots of the features that a span and its context have."""
    n = F.char_length(m)
    share = lambda pattern: F.floor(F.char_length(F.regexp_replace(m, pattern, "")) * 4 / n).cast("int")
    has = [F.when(F.contains(m, F.lit(c)), F.lit(18 + i)) for i, c in enumerate("_+/-=.( ")]
    sides = [r"^$", r"[\x20\t]$", r"[=:]$", r"[\"'`]$", r"[/\\#.]$", r"[(<\[{]$", r"[\r\n]$"]
    side = F.lit(33)
    for i, p in reversed(list(enumerate(sides))):
        side = F.when(left.rlike(p), F.lit(26 + i)).otherwise(side)
    slots = [
        F.lit(0),
        F.least(F.floor(F.log2(n.cast("double"))), F.lit(7)).cast("int") + 1,  # 1..8
        share("[^0-9]") + 9,  # 9..13
        F.least(share("[^A-Z]"), F.lit(3)) + 14,  # 14..17
        *has,  # 18..25
        side,  # 26..33
        F.when(m.rlike(STRICT[kind]), F.lit(34)),
        F.when(_among(before, FOR), F.lit(35)),
        F.when(_among(before, AGAINST), F.lit(36)),
        F.when(left.rlike(r"[=:][\x20\"']*$"), F.lit(37)),
        F.when(F.size(before) > 0, F.pmod(F.xxhash64(F.get(before, F.size(before) - 1)), F.lit(WORDS)).cast("int") + 38),  # 38..53
    ]
    return F.filter(F.array(*slots), lambda s: s.isNotNull())


def _judged(found, kind: str):
    k = KINDS.index(kind)

    def judged(x, before):
        m, left = x["found"], x["left"]
        share = F.char_length(_digits(m)) / F.char_length(m)
        votes = [
            _vote(m.rlike(STRICT[kind]), ~m.rlike(STRICT[kind]) & F.lit(kind != "secret")),
            _vote(_among(before, FOR), _among(before, AGAINST)),
            _vote(left.rlike(r"[=:][\x20\"']*$"), left.rlike(r"[/#.\\][\x20]?$")),
            _vote(share.between(0.15, 0.85), m.rlike("[a-z]{12}")) if kind == "secret" else _vote(F.lit(kind == "identity"), F.lit(False)),
        ]
        return F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), F.concat(F.lit(str(k)), *votes).alias("votes"), _features(kind, m, left, before).alias("features"))

    words = lambda x: F.filter(F.split(F.lower(x["left"]), "[^a-z0-9]+"), lambda w: w != "")
    last = lambda w: F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))
    return F.transform(found, lambda x: let(words(x), lambda w: let(last(w), lambda before: judged(x, before))))


def candidates(text):
    """array<struct<start, kind index, end, votes, features>>; votes: the kind and one sign for each labeler."""
    out = []
    for kind, pattern in WIDE.items():
        found = find_all(text, pattern, context=True)
        if kind == "secret":
            found = F.filter(found, lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]"))
        out.append(_judged(found, kind))
    return F.array_sort(F.concat(*out))


def estimate(counts: dict[str, int], rounds: int = 100) -> dict[str, float]:
    """Probability that a candidate with these votes is personal data, by expectation-maximisation over all counts."""
    result: dict[str, float] = {}
    for kind in sorted({v[0] for v in counts}):
        own = {v[1:]: n for v, n in counts.items() if v[0] == kind}
        total = sum(own.values())
        p = {v: min(0.95, max(0.05, 0.5 + 0.2 * (v.count("+") - v.count("-")))) for v in own}
        for _ in range(rounds):  # labelers are independent, given whether the candidate is personal data
            prior = (sum(n * p[v] for v, n in own.items()) + 1) / (total + 2)
            given = []
            for side in (1, 0):
                weight = {v: n * (p[v] if side else 1 - p[v]) for v, n in own.items()}
                mass = sum(weight.values())
                # a labeler is taken to be right more often than wrong: one pseudo-count in eight leans to its side
                given.append([{s: (sum(w for v, w in weight.items() if v[i] == s) + (4 if s == ("+" if side else "-") else 1)) / (mass + 6) for s in "+-0"} for i in range(VOTES)])
            for v in own:
                yes, no = prior, 1 - prior
                for i, s in enumerate(v):
                    yes, no = yes * given[0][i][s], no * given[1][i][s]
                p[v] = yes / (yes + no)
        result |= {kind + v: q for v, q in p.items()}
    return result


def train(rows: list[tuple[int, list[int], float]], rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of all kinds' slots from (kind, slots, probability): logistic regression, by Newton's steps for each kind."""
    out = np.zeros(len(KINDS) * SLOTS)
    for kind in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == kind]
        x = np.zeros((len(own), SLOTS))
        for i, (_, slots, _) in enumerate(own):
            x[i, slots] = 1.0
        p, w = np.array([r[2] for r in own]), np.zeros(SLOTS)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (p - q) / len(own) - ridge * w
            bend = (x * (q * (1 - q))[:, None]).T @ x / len(own) + ridge * np.eye(SLOTS)
            step = np.linalg.solve(bend, slope)
            w = w + step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        out[kind * SLOTS : (kind + 1) * SLOTS] = w
    return out


def _fit(seen: DataFrame) -> np.ndarray:
    """Weights of the final classifier, from a stored frame with the column `more`."""
    each = seen.select(F.explode("more").alias("c"))
    counts = {r["votes"]: r["n"] for r in each.groupBy("c.votes").agg(F.count("*").alias("n")).collect()}  # at most kinds x 81 rows
    told = estimate(counts)
    some = each.select("c.kind", "c.features", "c.votes", F.xxhash64("c.votes", "c.features", "c.start", "c.end").alias("h")).orderBy("h").limit(SAMPLE)
    return train([(r["kind"], r["features"], told[r["votes"]]) for r in some.collect()])


def _spans(weights: np.ndarray, accept: float):
    """From the columns base and more, all spans: array<struct<start, kind, end>>."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    score = lambda c: F.aggregate(c["features"], F.lit(0.0), lambda a, s: a + F.get(table, c["kind"] * SLOTS + s))
    bound = float(np.log(accept / (1 - accept)))
    right = F.filter("more", lambda c: score(c) >= bound)
    of = lambda s, added: F.struct(s["start"].alias("start"), F.lit(added).alias("added"), s["kind"].alias("kind"), s["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform("base", lambda s: of(s, 1)), F.transform(right, lambda s: of(s, 2))))
    # an added span goes if one before it reaches into it, or if a base span begins inside it
    far = 1 << 30
    reach = lambda o: cumulated(F.transform(o, lambda s: s["end"]), "max")
    ahead = lambda o: cumulated(F.reverse(F.transform(o, lambda s: F.when(s["added"] == 1, far - s["start"]).otherwise(F.lit(0)))), "max")

    def free(s, i, o, reached, nearest):
        return (s["added"] == 1) | ((F.get(reached, i) <= s["start"]) & (far - F.get(nearest, F.size(o) - 1 - i) >= s["end"]))

    kept = let(both, lambda o: let(reach(o), lambda reached: let(ahead(o), lambda nearest: F.filter(o, lambda s, i: free(s, i, o, reached, nearest)))))
    return F.when(F.size("more") > 0, F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))).otherwise(F.col("base"))


def _seen(documents: DataFrame, text, *keep) -> DataFrame:
    text = F.coalesce(text, F.lit(""))
    return written(documents.select(*keep, base_spans(text).alias("base"), candidates(text).alias("more")), "pii-candidates")


def find(documents: DataFrame, *, accept: float = 0.8) -> DataFrame:
    """doc_id, base and spans: array<struct<start, kind, end>> (kind: its place in KINDS), one row for each document."""
    seen = _seen(only_columns(documents, "doc_id", "text"), F.col("text"), "doc_id")
    return seen.select("doc_id", "base", _spans(_fit(seen), accept).alias("spans"))


def _written_out(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_digest(documents: DataFrame) -> DataFrame:
    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    n = [count(k) for k in range(4)]
    return find(documents).select("doc_id", *n, F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"), _written_out(F.col("spans")).alias("spans"))


def _replaced(text, spans):
    """text with each span as its kind in angle brackets. It is cut into blocks once, so that no place is counted from the start."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    apart = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), spans.alias("spans"), F.char_length(text).alias("n"))

    def between(o, a, z):
        p, q = F.floor(a / BLOCK).cast("int"), F.floor((z - 1) / BLOCK).cast("int")
        whole = F.concat(F.substring(F.get(o["blocks"], p), a % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(o["blocks"], p + 2, F.greatest(q - p - 1, F.lit(0))), ""), F.substring(F.get(o["blocks"], q), F.lit(1), (z - 1) % BLOCK + 1))
        return F.when(a >= z, F.lit("")).when(p == q, F.substring(F.get(o["blocks"], p), a % BLOCK + 1, z - a)).otherwise(whole)

    def piece(o, i):
        a = F.when(i > 0, F.get(o["spans"], i - 1)["end"]).otherwise(F.lit(0))
        z = F.when(i < F.size(o["spans"]), F.get(o["spans"], i)["start"]).otherwise(o["n"])
        return F.concat(between(o, a, z), F.when(i < F.size(o["spans"]), F.get(names, F.get(o["spans"], i)["kind"])).otherwise(F.lit("")))

    return let(apart, lambda o: F.array_join(F.transform(F.sequence(F.lit(0), F.size(o["spans"])), lambda i: piece(o, i)), ""))


def redacted(documents: DataFrame, *, accept: float = 0.8) -> DataFrame:
    """documents with each span of text replaced by its kind in angle brackets; n_chars, if there, follows.

    Of base spans that overlap, the first one is replaced, and of the others what reaches beyond it.
    """
    at = place_of(documents, "text")
    n_chars = next((i for i, c in enumerate(documents.columns) if c == "n_chars"), None)
    rows = numbered(documents)
    seen = _seen(rows, F.col(f"`#{at}`"), *[F.col(f"`{c}`") for c in rows.columns])
    spans = _spans(_fit(seen), accept)
    text = F.col(f"`#{at}`")
    new = F.when(F.size("base") + F.size("more") > 0, _replaced(text, _apart(spans))).otherwise(text)
    out = seen.withColumn("new", new)
    return out.select(*[F.col("new") if i == at else F.char_length("new").cast("long") if i == n_chars else F.col(f"`{c}`") for i, c in enumerate(rows.columns)]).toDF(*documents.columns)


def _apart(spans):
    """Sorted spans, each from where all before it end; those that lie inside others go."""
    moved = lambda o, reach: F.transform(o, lambda s, i: F.struct(F.greatest(s["start"], F.get(reach, i)).alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    all_ = let(spans, lambda o: let(cumulated(F.transform(o, lambda s: s["end"]), "max"), lambda reach: moved(o, reach)))
    return F.filter(all_, lambda s: s["start"] < s["end"])
