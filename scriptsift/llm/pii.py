"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans.  Labelers vote on every proposal: a format labeler (checksums
and shapes), a gazetteer labeler (known names and words) and context
labelers (cue words and neighbours).  A vote is for, against or none.
Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, without labels; proposals of a base kind that pass
its rule are known to be right and anchor it.  The posteriors then train the
final span classifier, a logistic model over kinds and votes, which decides on
all proposals beyond the base ones.

Only the counts of vote patterns reach the driver; there are at most
``len(KINDS) · 3 ** len(LABELERS)`` of them, however many texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import bind
from .common import stage
from .spans import NONE, count_kind, in_order, matches, of_kinds, written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "ssn", "iban", "name", "account")
CONTEXT = 40
ROUNDS = 50
ACCEPT = 0.5

GIVEN_NAMES = (
    "James John Robert Michael William David Mary Patricia Jennifer Linda Elizabeth Barbara Susan Hans Klaus Peter Wolfgang "
    "Ursula Monika Sabine Jean Pierre Michel Marie Nathalie Isabelle Juan Carlos Antonio Carmen Pilar").split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Mme Mlle Sr Sra".split()
CUES = {
    "email": "mail contact write correo kontakt", "ip": "ip server host address login", "card": "card visa credit karte tarjeta carte",
    "phone": "phone tel call fax mobile telefon", "ssn": "ssn social security", "iban": "iban bank konto compte cuenta",
    "name": "name contact signed patient dear", "account": "account acct konto cuenta compte customer",
}
_DIGITS = r"[^0-9]"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, _DIGITS, "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def worth(i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _small_parts(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.coalesce(
        F.regexp_replace(p, "^0+", "").try_cast("int") <= 255, F.regexp_replace(p, "^0+", "") == ""))


def _card(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(12, 19) & luhn(d)


# Loops are possessive and runs are entered at their start only, or where the
# last match ended: the same matches as the plain expressions, in linear time.
_EMAIL = r"(?=[A-Za-z0-9._%+-])(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){11,}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_NAME = (
    rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{L}}{{1,30}}|(?:{'|'.join(GIVEN_NAMES)}))\x20\p{{Lu}}\p{{L}}{{1,30}}(?![\p{{L}}])")
_ACCOUNT = r"(?<![0-9A-Za-z.+-])[0-9]{8,17}(?![0-9A-Za-z.-])"


def proposals(text: Column) -> Column:
    """Spans proposed by the patterns, by start, then kind.  ``ord`` is the kind's number."""
    n = {k: i for i, k in enumerate(KINDS)}
    return in_order(
        matches(text, "email", n["email"], _EMAIL, text.contains("@"), None, CONTEXT),
        matches(text, "ip", n["ip"], _IP, None, _small_parts, CONTEXT),
        matches(text, "card", n["card"], _CARD, None, _card, CONTEXT),
        matches(text, "phone", n["phone"], _PHONE, text.contains("+"), lambda v: F.length(_digits(v)).between(9, 15), CONTEXT),
        matches(text, "ssn", n["ssn"], _SSN, None, None, CONTEXT),
        matches(text, "iban", n["iban"], _IBAN, None, None, CONTEXT),
        matches(text, "name", n["name"], _NAME, None, None, CONTEXT),
        matches(text, "account", n["account"], _ACCOUNT, None, None, CONTEXT))


def _vote(for_: Column, against: Column) -> Column:
    return F.when(for_, 1).when(against, -1).otherwise(0)


def _iban_ok(v: Column) -> Column:
    """Remainder 1 modulo 97 with letters as two digits, country first moved last."""
    bare = F.regexp_replace(v, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    code = lambda i: F.ascii(F.substring(moved, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(moved)), F.lit(0),
        lambda r, i: F.when(code(i) < 65, (r * 10 + code(i) - 48) % 97).otherwise((r * 100 + code(i) - 55) % 97)) == 1


def _format(s: Column) -> Column:
    v, kind = s["value"], s["kind"]
    return (
        F.when(kind == "ssn", _vote(~v.rlike("^(?:000|666|9)|-00-|-0000$"), F.lit(True)))
        .when(kind == "iban", _vote(_iban_ok(v), F.lit(True)))
        .when(kind == "account", _vote(F.lit(False), F.length(v) < 10))
        .when(kind == "name", 0).otherwise(1))


def _gazetteer(s: Column) -> Column:
    v, kind = s["value"], s["kind"]
    names = "|".join(GIVEN_NAMES)
    return (
        F.when(kind == "name", _vote(v.rlike(rf"(?:^|\x20)(?:{names})\x20"), F.lit(False)))
        .when(kind == "email", _vote(v.rlike(r"\.(?:com|org|net|edu|gov|de|fr|es|uk|eu|info|io)$"), F.lit(False)))
        .when(kind == "ip", _vote(F.lit(False), v.rlike(r"^(?:0|127|255)\.")))
        .when(kind == "account", _vote(F.lit(False), v.rlike(r"^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])[0-3][0-9]$|^([0-9])\1+$")))
        .otherwise(0))


def _cue(s: Column) -> Column:
    out = F.lit(0)
    for kind, cues in CUES.items():
        near = rf"(?i)(?<![\p{{L}}])(?:{'|'.join(cues.split())})(?:s|e|en|-?nr|-?number)?(?![\p{{L}}])"
        out = F.when((s["kind"] == kind) & s["before"].rlike(near), 1).otherwise(out)
    silent = s["kind"].isin("account", "ssn", "name") & (out == 0)
    return F.when(silent, -1).otherwise(out)


def _edges(s: Column) -> Column:
    """Against spans that continue a word or number; for spans set off by white space."""
    glued = s["before"].rlike(r"[\p{L}0-9]$") | s["after"].rlike(r"^[\p{L}0-9]")
    apart = s["before"].rlike(r"(?:^|[\s(\"':<])$") & s["after"].rlike(r"^(?:$|[\s)\"'.,;:!?>])")
    return _vote(apart, glued)


LABELERS = (("format", _format), ("gazetteer", _gazetteer), ("cue", _cue), ("edges", _edges))


def votes(span: Column) -> Column:
    """Kind and votes of one proposal, such as ``6:1,0,-1,1``."""
    return F.concat_ws(":", span["ord"], F.concat_ws(",", *[labeler(span).cast("string") for _, labeler in LABELERS]))


def estimate(counts: dict, rounds: int = ROUNDS):
    """Expectation-maximisation over (kind number, votes) -> count.

    Returns (posterior of each pattern, reliabilities, share of right proposals by kind).  Reliability
    is the probability of each vote given that a proposal is right or wrong.
    Base kinds are right by rule.  Counts start smoothed, and votes start as
    better than chance, which settles which side is which.
    """
    labelers = len(LABELERS)
    right = [{1: 0.6, 0: 0.3, -1: 0.1} for _ in range(labelers)]
    wrong = [{1: 0.1, 0: 0.3, -1: 0.6} for _ in range(labelers)]
    prior = {k: 0.5 for k in range(len(KINDS))}
    posterior = {}
    for _ in range(rounds):
        for (kind, vote), _n in counts.items():
            a, b = math.log(prior[kind]), math.log(1 - prior[kind])
            for j, v in enumerate(vote):
                a, b = a + math.log(right[j][v]), b + math.log(wrong[j][v])
            posterior[kind, vote] = 1.0 if kind < len(BASE) else 1 / (1 + math.exp(min(max(b - a, -60), 60)))
        for kind in prior:
            got = sum(n * posterior[k, v] for (k, v), n in counts.items() if k == kind)
            all_ = sum(n for (k, _), n in counts.items() if k == kind)
            prior[kind] = min(max((got + 1) / (all_ + 2), 1e-6), 1 - 1e-6)
        for j in range(labelers):
            for table, side in ((right, 1), (wrong, 0)):
                weight = {v: 1.0 for v in (1, 0, -1)}
                for (kind, vote), n in counts.items():
                    p = posterior[kind, vote]
                    weight[vote[j]] += n * (p if side else 1 - p)
                total = sum(weight.values())
                table[j] = {v: w / total for v, w in weight.items()}
    return posterior, list(zip(right, wrong)), prior


def fit(counts: dict, posterior: dict, steps: int = 400, rate: float = 0.5, decay: float = 1e-3):
    """Logistic model over kind and votes, taught by the posteriors: (weight by kind, weights by labeler and vote)."""
    by_kind = [0.0] * len(KINDS)
    by_vote = [{1: 0.0, 0: 0.0, -1: 0.0} for _ in LABELERS]
    total = sum(counts.values()) or 1
    for _ in range(steps):
        kind_step = [decay * w for w in by_kind]
        vote_step = [{v: decay * w for v, w in ws.items()} for ws in by_vote]
        for (kind, vote), n in counts.items():
            z = by_kind[kind] + sum(by_vote[j][v] for j, v in enumerate(vote))
            error = (1 / (1 + math.exp(-min(max(z, -60), 60))) - posterior[kind, vote]) * n / total
            kind_step[kind] += error
            for j, v in enumerate(vote):
                vote_step[j][v] += error
        by_kind = [w - rate * s for w, s in zip(by_kind, kind_step)]
        by_vote = [{v: ws[v] - rate * ss[v] for v in ws} for ws, ss in zip(by_vote, vote_step)]
    return by_kind, by_vote


def train(proposed: DataFrame, spans: str = "proposed"):
    """Span classifier from a table with an array of proposals."""
    rows = proposed.select(F.explode(F.transform(spans, votes)).alias("votes")).groupBy("votes").count().collect()
    counts = {}
    for r in rows:
        kind, vote = r["votes"].split(":")
        counts[int(kind), tuple(int(v) for v in vote.split(","))] = r["count"]
    posterior, _, _ = estimate(counts)
    return fit(counts, posterior)


def accepted(spans: Column, model) -> Column:
    """Base spans, and those beyond them that the classifier takes."""
    by_kind, by_vote = model
    weights = F.array(*[F.lit(float(w)) for w in by_kind])

    def right(s):
        z = F.get(weights, s["ord"])
        for (_, labeler), ws in zip(LABELERS, by_vote):
            vote = labeler(s)
            z = z + F.when(vote == 1, ws[1]).when(vote == -1, ws[-1]).otherwise(ws[0])
        return (s["ord"] < len(BASE)) | (z > math.log(ACCEPT / (1 - ACCEPT)))
    return F.filter(spans, right)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model=None) -> DataFrame:
    """One row per document with the personal data of its whole text.

    Columns: the id, number of spans of each base kind, ``base_sha256`` and
    ``spans``.  Null reads as empty; repeated rows are repeated; null ids stay
    null; other columns are ignored; an empty table gives no rows.  Without
    ``model`` one is trained on the same texts.
    """
    proposed = stage(
        docs.select(F.col(doc_id).alias(doc_id), proposals(F.coalesce(F.col(text), F.lit(""))).alias("proposed")), "pii-proposals")
    taken = accepted(F.col("proposed"), model or train(proposed))
    return (
        proposed.select(doc_id, taken.alias("found"))
        .select(doc_id, *[count_kind(F.col("found"), k).alias(f"n_{k}") for k in BASE],
                F.sha2(written(of_kinds(F.col("found"), BASE)), 256).alias("base_sha256"), written(F.col("found")).alias("spans")))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    empty = F.expr(NONE)

    def join(a, s):
        last = F.get(a, F.size(a) - 1)
        longer = F.struct(
            last["start"].alias("start"), last["ord"].alias("ord"), F.greatest(last["end"], s["end"]).alias("end"),
            *[last[c].alias(c) for c in ("kind", "value", "before", "after")])
        return F.when((F.size(a) > 0) & (s["start"] < last["end"]), F.array_append(F.slice(a, F.lit(1), F.size(a) - 1), longer)).otherwise(F.array_append(a, s))

    merged = F.aggregate(spans, empty, join)
    parts = bind(merged, lambda m: F.concat(
        F.transform(m, lambda s, i: F.concat(
            F.substring(text, F.coalesce(F.get(m, i - 1)["end"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(m, i - 1)["end"], F.lit(0))),
            F.lit("["), F.upper(s["kind"]), F.lit("]"))),
        F.array(F.substr(text, F.get(m, F.size(m) - 1)["end"] + 1))))
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(parts, ""))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in the text column; null texts stay null."""
    rows = docs.withColumn("__proposed", F.when(F.col(text).isNull(), F.expr(NONE)).otherwise(proposals(F.col(text))))
    seen = stage(rows, "pii-texts")
    model = train(seen, "__proposed")
    out = seen.withColumn("__spans", accepted(F.col("__proposed"), model)).withColumn(text, masked(F.col(text), F.col("__spans")))
    return out.select(*docs.columns)
