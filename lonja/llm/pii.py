"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span
classifier is trained on the result.

Base spans are what fixed patterns find and checks confirm; they always stay. Candidates are what
wider patterns find: telephone numbers as they are written inside a country, e-mail addresses written
out, addresses of sixteen bytes, card numbers with other separators or at the start or end of a longer
row of digits. What the base patterns find and a check turns down is a candidate only if it can still
be personal data: a telephone number of seven or eight digits. A check that can tell is final: no card
number fails Luhn's, none is part of a longer word, and forms that prices and tables have too
need a cue word. On every candidate and base span four labelers vote for, against, or not at all:

* ``regex``: the strict pattern and its check; it says nothing of what only a wider one finds,
* ``gazetteer``: known top-level domains, issuer digits, area forms, address ranges,
* ``context``: a cue word before the span, in English, Spanish, French or German,
* ``shape``: how the parts are grouped and what stands beside the span.

Expectation maximisation over the counts of equal votes estimates for each kind how often it is
right, and how reliable each labeler is. A logistic span classifier is then trained on the
posteriors, over counts of equal features, and candidates it accepts become spans where no base
span stands. What reaches the driver are the counts: at most one row for each combination of votes
or of features, whatever the number of documents.

Everything is DataFrame functions. Defined results: a null text is an empty one; rows are judged one
by one, also those that repeat an id or have none; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.runtime import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape")
FEATURES = (*LABELERS, "wide", "many_digits")
ROUNDS = 30
_CONTEXT = 24

# Patterns name runs possessively and look behind only once, so they take linear time: a match may
# begin at the start of a run, or where the last match ended.
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_FRENCH = r"0[1-9](?:[ .-][0-9]{2}){4}"
_AMERICAN = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
_SPANISH = r"[6789][0-9]{2}(?:(?:[ .-][0-9]{3}){2}|(?:[ .-][0-9]{2}){3})"
_GERMAN = r"\(?0[1-9][0-9]{1,4}\)?[ /-][0-9]{4,9}"
_WIDE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:[(\[]dot[)\]]|\.) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}([ ./_-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])",
    "phone": rf"(?<![0-9A-Za-z+.,(/-])(?:{_FRENCH}|{_AMERICAN}|{_SPANISH}|{_GERMAN})(?![0-9A-Za-z])",
}
#: What a text must have for a pattern to be tried.
_NEEDS = {
    ("email", False): lambda t: F.instr(t, "@") > 0,
    ("email", True): lambda t: t.rlike(r"[(\[]at[)\]]"),
    ("ip", False): lambda t: t.rlike(r"[0-9]\.[0-9]"),
    ("ip", True): lambda t: t.rlike(r"[0-9A-Fa-f]::?[0-9A-Fa-f]"),
    ("card", False): lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    ("card", True): lambda t: t.rlike(r"[0-9]{4}[ ./_-]?[0-9]{4}"),
    ("phone", False): lambda t: F.instr(t, "+") > 0,
    ("phone", True): lambda t: t.rlike(r"[0-9]\)?[ ./-][0-9]{2}"),
}

# Lists that the labelers look up.
_DOMAINS = (
    "com org net edu gov mil int info biz name pro io ai app dev me tv cc eu "
    "ar at au be bg br ca ch cl cn co cr cu cy cz de dk do ec ee es fi fr gr gt hk hr hu ie il in ir is it "
    "jp ke kr lt lu lv ma mt mx my ng nl no nz pa pe ph pk pl pt py ro rs ru se sg si sk th tn tr tw ua uk us uy ve vn za"
).split()
_CUES = {
    "email": "e-?mail|contact|write|reach|correo|contacto|courriel|kontakt|schreib",
    "ip": "ip|host|server|address|addr|servidor|direcci|serveur|adresse",
    "card": "card|visa|mastercard|amex|credit|payment|pay|tarjeta|pago|carte|paiement|karte|kreditkarte|zahlung",
    "phone": "phone|tel|call|fax|mobile|cell|m.vil|llam|t.l.phone|appel|portable|handy|anruf|rufnummer",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, at most 19, pass the Luhn check."""

    def add(total: Column, place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        doubled = (F.length(digits) - place) % 2 == 1
        return total + F.when(doubled, digit * 2 - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _confirmed(kind: Column, value: Column) -> Column:
    """Whether a match of a strict pattern is a base span."""
    digits = F.length(_digits(value))
    parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    small = F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == "ip", small)
        .when(kind == "card", F.when(digits.between(12, 19), _luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", digits.between(9, 15))
        .otherwise(True)
    )


def _found(kind: str, wide: bool) -> Column:
    """All matches with the length of the text before each, and some of that text."""
    pattern = F.lit(_WIDE[kind] if wide else _PATTERNS[kind])
    text = F.col("text")
    pieces = F.transform(
        F.split(text, pattern, -1),
        lambda p: F.struct(F.char_length(p).alias("gap"), F.lower(F.right(p, F.lit(_CONTEXT))).alias("before")),
    )
    rows = F.arrays_zip(pieces.alias("piece"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"))
    kept = F.transform(
        rows,
        lambda r, n: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(wide).alias("wide"),
            n.alias("n"),
            r["piece"]["gap"].alias("gap"),
            r["piece"]["before"].alias("before"),
            r["value"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<kind:string,wide:boolean,n:int,gap:int,before:string,value:string>>")
    return F.when(_NEEDS[kind, wide](text), F.filter(kept, lambda r: r["value"].isNotNull())).otherwise(none)


def _matches(docs: DataFrame) -> DataFrame:
    """One row per document, with the matches of all patterns; written, as it numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = [_found(kind, wide) for kind, wide in _NEEDS]
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    return stage(numbered.select("row", "doc_id", F.concat(*found).alias("found")), "pii-matches")


def _spans(matches: DataFrame) -> DataFrame:
    """Base spans and candidates: places in code points, and the labelers' votes."""
    rows = matches.select("row", F.explode("found").alias("f")).select("row", "f.*")
    order = Window.partitionBy("row", "kind", "wide").orderBy("n")
    length = F.char_length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(order)).withColumn("start", F.col("end") - length)
    kind, value = F.col("kind"), F.col("value")
    digits = F.length(_digits(value))
    inside = F.col("before").rlike("[0-9a-z]$")
    clear = value.rlike(rf"^(?:{_FRENCH}|{_AMERICAN})$")
    likely = (
        F.when(kind == "card", F.when(F.col("wide"), _luhn(_digits(value))).otherwise(False))
        .when(kind == "ip", F.col("wide"))
        .when(kind == "phone", F.when(F.col("wide"), clear | _cue(kind)).otherwise(digits.between(7, 15) & ~inside))
        .otherwise(True)
    )
    rows = rows.withColumn("base", ~F.col("wide") & _confirmed(kind, value)).where(F.col("base") | likely)
    votes = _votes(kind, value, digits)
    return rows.withColumns(
        {**votes, "many_digits": F.when(digits >= 10, 1).otherwise(0), "wide": F.col("wide").cast("int")}
    )


def _cue(kind: Column) -> Column:
    """Whether a cue word stands before the span."""
    cue = F.lit(False)
    for name, words in _CUES.items():
        cue = F.when(kind == name, F.col("before").rlike(rf"\b(?:{words})")).otherwise(cue)
    return cue


def _votes(kind: Column, value: Column, digits: Column) -> dict[str, Column]:
    domain = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    first = F.ltrim(F.split(value, r"\.")[0], F.lit("0"))
    cue, wide = _cue(kind), F.col("wide")
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    gazetteer = (
        F.when(kind == "email", F.when(domain.isin(_DOMAINS), yes).otherwise(no))
        .when((kind == "ip") & wide, F.when(F.lower(value).rlike("^(?:2[0-9a-f]{3}|f[cde][0-9a-f]{2}):"), yes).otherwise(no))
        .when(kind == "ip", F.when((first == "") | (F.length(first) > 3), no).otherwise(yes))
        .when(kind == "card", F.when(value.rlike("^[3-6]"), yes).otherwise(no))
        .when(wide, F.when(value.rlike(rf"^(?:{_FRENCH}|\(?[2-9][0-9]{{2}}\)?[ .-][2-9].*)$"), yes).otherwise(none))
        .otherwise(F.when(value.rlike(r"^\+?(?:1|[2-9][0-9]{0,2})?[ .-]?\(?[0-9]{3}\)?"), yes).otherwise(none))
    )
    shape = (
        F.when(kind == "email", yes)
        .when(kind == "ip", F.when(value.rlike(r"(?:^|\.)0[0-9]"), no).otherwise(yes))
        .when(kind == "card", F.when(value.rlike(r"^[0-9]{12,19}$|^[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$"), yes).otherwise(no))
        .otherwise(F.when(digits.between(9, 15), yes).otherwise(no))
    )
    return {
        "regex": F.when(F.col("base"), yes).when(wide, none).otherwise(no),
        "gazetteer": gazetteer,
        "context": F.when(cue, yes).otherwise(none),
        "shape": shape,
    }


def reliabilities(counts: list[dict]) -> tuple[dict[str, float], dict[tuple[str, str], dict[int, tuple[float, float]]]]:
    """By expectation maximisation: the share of true spans of each kind, and for each kind and
    labeler how likely each vote is on a false and on a true span, if it votes at all.

    ``counts`` has ``kind``, the votes and ``count``.
    """
    share, chance = {}, {}
    for kind in sorted({row["kind"] for row in counts}):
        rows = [row for row in counts if row["kind"] == kind]
        belief = [1 / (1 + math.exp(-2.0 * sum(row[name] for name in LABELERS))) for row in rows]
        for _ in range(ROUNDS):
            true = sum(b * row["count"] for b, row in zip(belief, rows))
            total = sum(row["count"] for row in rows)
            share[kind] = (true + 1) / (total + 2)
            for name in LABELERS:
                said = [(b, row["count"], row[name]) for b, row in zip(belief, rows) if row[name]]
                on_true = sum(b * c for b, c, _ in said)
                on_false = sum((1 - b) * c for b, c, _ in said)
                chance[kind, name] = {}
                for vote in (-1, 1):
                    hits = [(b, c) for b, c, own in said if own == vote]
                    chance[kind, name][vote] = (
                        (sum((1 - b) * c for b, c in hits) + 0.5) / (on_false + 1),
                        (sum(b * c for b, c in hits) + 0.5) / (on_true + 1),
                    )
            belief = [posterior(row, share, chance) for row in rows]
    return share, chance


def posterior(row: dict, share: dict, chance: dict) -> float:
    """How likely a span with these votes is a true one."""
    odds = math.log(share[row["kind"]] / (1 - share[row["kind"]]))
    for name in LABELERS:
        if not row[name]:
            continue  # a labeler that does not vote says nothing
        on_false, on_true = chance[row["kind"], name][row[name]]
        odds += math.log(on_true / on_false)
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def classifier(counts: list[dict], beliefs: list[float], steps: int = 300) -> dict[str, list[float]]:
    """Logistic weights of each kind (the last is the bias), fitted to the posteriors."""
    weights = {}
    for kind in sorted({row["kind"] for row in counts}):
        rows = [([row[f] for f in FEATURES] + [1], row["count"], b) for row, b in zip(counts, beliefs) if row["kind"] == kind]
        total = sum(count for _, count, _ in rows)
        own = [0.0] * (len(FEATURES) + 1)
        for _ in range(steps):
            slope = [0.001 * w for w in own]
            for values, count, belief in rows:
                odds = sum(w * v for w, v in zip(own, values))
                error = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))) - belief
                slope = [s + error * v * count / total for s, v in zip(slope, values)]
            own = [w - s for w, s in zip(own, slope)]
        weights[kind] = own
    return weights


def train(spans: DataFrame) -> dict[str, list[float]]:
    """The span classifier, from the counts of equal votes and features."""
    counts = [row.asDict() for row in spans.groupBy("kind", *FEATURES).count().collect()]
    counts.sort(key=lambda row: (row["kind"], *(row[f] for f in FEATURES)))
    share, chance = reliabilities(counts)
    return classifier(counts, [posterior(row, share, chance) for row in counts])


def _accepted(weights: dict[str, list[float]]) -> Column:
    accepted = F.lit(False)
    for kind, own in weights.items():
        odds = F.lit(own[-1])
        for name, weight in zip(FEATURES, own):
            odds = odds + F.lit(weight) * F.col(name)
        accepted = F.when(F.col("kind") == kind, odds >= 0).otherwise(accepted)
    return accepted


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: kind, start, end (exclusive; code points) and whether it is base.

    Spans are in the order of their starts, then of the kinds.
    """
    matches = _matches(docs)
    spans = stage(_spans(matches), "pii-spans")
    weights = train(spans)
    chosen = spans.where(F.col("base") | _accepted(weights))
    place = Window.partitionBy("row").orderBy("start", F.desc("base"), "kind", "wide")
    before = F.max(F.when(F.col("base"), F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(place.rowsBetween(1, Window.unboundedFollowing))
    earlier = F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(earlier, F.lit(0)) <= F.col("start")) & (
        F.coalesce(before, F.lit(0)) <= F.col("start")
    ) & (after.isNull() | (after >= F.col("end")))
    chosen = chosen.withColumn("free", free).where(F.col("base") | F.col("free"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    listed = chosen.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "end", "kind", "base"))).alias("spans")
    )
    return matches.select("row", "doc_id").join(listed, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)).alias("spans")
    )
