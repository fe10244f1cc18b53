"""Personal data by weak supervision, in DataFrame expressions only.

Regular expressions propose spans. Labelers vote on each: how strictly it is formed, words before and behind it, words that
speak against it on either side, a gazetteer (top-level domains, issuer ranges, country and area codes, address blocks, key
prefixes) and its shape. Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is and
how likely each pattern is personal data; those probabilities train the final classifier of spans, a logistic regression on
the span's hashed shape and its neighbour words besides the votes, which is again a column expression. What reaches the
driver is one count for each pattern of votes and a bounded sample of feature rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import table

KINDS = ["email", "ip", "card", "phone", "secret"]

# The base patterns of the four kinds. Possessive loops and look-behinds change no match; they keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser proposals; the classifier decides on them.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?\"?[A-Za-z0-9+/_-]{8,}+\"?|\bAKIA[0-9A-Z]{16}\b",
}
#: What a loose proposal is like that is formed strictly.
STRICT = {
    "email": r"(?i)(?:\[dot\]|\(dot\)|\.)\x20?[a-z]{2,}$",
    "phone": r"^(?:\([0-9]{3}\)[\x20]?[0-9]{3}-[0-9]{4}|([0-9]{3})([\x20.-])[0-9]{3}\2[0-9]{4})$",
    "secret": r"^AKIA|[=:]\x20?\"?(?=[^\"]*[0-9])(?=[^\"]*[A-Za-z])",
}

# Words near personal data of each kind, and words near numbers that are none.
BEFORE = {
    "email": "e-?mail mail contact write reply address user from correo courriel",
    "ip": "ip address server host from client login addr adresse",
    "card": "card visa mastercard amex credit debit account karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax contact ring number dial telefon téléphone teléfono anrufen llamar appeler",
    "secret": "password passwd token key secret credential login aws access auth",
}
BEHIND = {
    "email": "mail contact",
    "ip": "host server port",
    "card": "exp expires cvv cvc valid",
    "phone": "ext extension call mobile fax phone",
    "secret": "password token key secret",
}
AGAINST_BEFORE = "version ver v release build order invoice isbn issn page item id figure section chapter article part serial ref reference case ticket sku lot model bestellung rechnung commande facture pedido factura"
AGAINST_BEHIND = "release version build units items pieces pages eur usd km kg percent"
# Common top-level domains; first digits of card issuers; address blocks that no one's host has; forms of national numbers.
DOMAINS = "com org net edu gov mil int info biz io co ai app dev me tv us uk de fr es it nl be ch at pl se no dk fi pt ie cz gr ro hu ru ua tr eu ca mx br ar cl cn jp kr in au nz za il"
ISSUERS = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|[689])|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])|62)"
NO_HOSTS = r"^(?:0|127|22[4-9]|2[3-5][0-9])\.|^169\.254\.|^255\.|\.0\.0\.0$"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9])"
AREA_CODES = r"^\(?[2-9][0-8][0-9]\D{1,2}[1-9]"
KEYS = r"^AKIA|[=:]\x20?\"?(?:(?i:[0-9a-f]{16,})|ghp_|sk-|xox[a-z]-|eyJ)"


def _near(words: str, behind: bool) -> str:
    """A pattern for one of ``words`` among the few signs and words next to a span."""
    listed = "|".join(words.split())
    return rf"(?i)^[^\n\w]{{0,3}}(?:\w+[^\n\w]{{1,2}})?(?:{listed})\b" if behind else rf"(?i)(?<!\w)(?:{listed})\b[^\n\w]{{0,3}}(?:\w+[^\n\w]{{1,3}}){{0,2}}$"


#: Labelers, and how often each is thought to be right before any count.
ACCURACY = {"pattern": 0.7, "before": 0.85, "behind": 0.8, "against": 0.9, "gazetteer": 0.65, "shape": 0.6}
VOTES = list(ACCURACY)
#: Share of proposals thought to be personal data before any vote.
PROPOSED = 0.6
#: Buckets of hashed shapes and of hashed neighbour words, and feature rows that the classifier is fitted on at most.
SHAPES, WORDS, SAMPLE_ROWS = 64, 128, 10_000
#: Characters looked at on either side of a span.
CONTEXT = 40


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(text)
    n = F.length(d)

    def part(i: Column) -> Column:
        x = F.substring(d, n + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), part), F.lit(0), lambda a, x: a + x)
    return F.when((n >= 14) & (n <= 19), total % 10 == 0).otherwise(False)


def _octets(text: Column) -> Column:
    def small(p: Column) -> Column:
        x = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(F.length(x) <= 3, x.cast("int") <= 255).otherwise(False)

    return F.forall(F.split(text, r"\."), small)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
    "secret": lambda m: F.lit(True),
}
SPAN = "struct<kind:int,start:int,end:int,m:string>"
VOTED = "struct<kind:int,start:int,end:int,base:boolean," + ",".join(f"{v}:int" for v in [*VOTES, "form", "left", "right"]) + ">"
NONE = f"CAST(array() AS array<{SPAN}>)"


def _found(rows: DataFrame, kind: str, pattern: str, needs: Column, name: str) -> DataFrame:
    """``rows`` with a column of spans (kind, start, end, m): the pattern's leftmost matches in ``text``; positions are code points, the end exclusive.

    The texts between the matches come from a split by the same pattern, so a match starts where the lengths before it
    add up to. Matches, gaps and spans are steps of their own, so that no pattern runs twice.
    """
    none = F.expr("CAST(array() AS array<string>)")
    rows = rows.withColumn("_m", F.when(needs, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(none))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(KINDS.index(kind)).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with("_g", "_m", lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("spans"))
    rows = rows.withColumn("_p", F.filter(pairs, lambda x: x["m"].isNotNull()))
    return rows.withColumn(name, F.when(F.size("_p") > 0, F.aggregate("_p", begin, step)["spans"]).otherwise(F.expr(NONE))).drop("_m", "_g", "_p")


def _valid(kind: str):
    return lambda s: VALID[kind](s["m"])


def _needs(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {"email": text.contains("@"), "loose email": text.rlike("(?i)[\\[(]at[\\])]"), "ip": digit, "card": digit, "phone": text.contains("+"), "loose phone": digit, "secret": text.rlike("(?i)password|passwd|pwd|token|secret|api[_-]?key|AKIA")}


def annotate(documents: DataFrame) -> DataFrame:
    """doc_id, text, ``base`` (valid spans of the four base kinds), ``more`` (other proposals, none over a base span) and ``_row`` (the whole row)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"])
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.col("text").isNull().alias("_null"), whole.alias("_row"))
    needs = _needs(F.col("text"))
    for kind, pattern in BASE.items():
        rows = _found(rows, kind, pattern, needs[kind], f"_{kind}")
        rows = rows.withColumn(f"_{kind}", F.filter(f"_{kind}", _valid(kind)))
    for kind in LOOSE:
        rows = _found(rows, kind, LOOSE[kind], needs.get(f"loose {kind}", needs[kind]), f"_loose_{kind}")
    rows = rows.withColumn("base", F.array_sort(F.concat(*[f"_{k}" for k in BASE]), _by_start))
    clear = F.filter(F.concat(*[f"_loose_{k}" for k in LOOSE]), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.withColumn("more", clear).select("doc_id", "text", "_null", "_row", "base", "more")


def _by_start(a: Column, b: Column) -> Column:
    less = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["kind"] < b["kind"]) | ((a["kind"] == b["kind"]) & (a["end"] < b["end"]))))
    same = (a["start"] == b["start"]) & (a["kind"] == b["kind"]) & (a["end"] == b["end"])
    return F.when(less, F.lit(-1)).when(same, F.lit(0)).otherwise(F.lit(1))


def _of_kind(kind: Column, make, otherwise: Column) -> Column:
    """``make`` of the kind's name, for those kinds for which it isn't None."""
    out = otherwise
    for i, name in enumerate(KINDS):
        made = make(name)
        out = out if made is None else F.when(kind == i, made).otherwise(out)
    return out


def voted(annotated: DataFrame) -> DataFrame:
    """doc_id and ``spans``: kind, start, end, base, the votes (1 for, 0 against, -1 no opinion) and the classifier's hashed features of every proposal."""
    flag = lambda c, yes, no: F.when(c, F.lit(yes)).otherwise(F.lit(no))

    def votes(base: bool):
        def one(s: Column) -> Column:
            kind, m = s["kind"], s["m"]
            low = F.greatest(s["start"] - CONTEXT, F.lit(0))
            before, behind = F.substring(F.col("text"), low + 1, s["start"] - low), F.substring(F.col("text"), s["end"] + 1, F.lit(CONTEXT))
            listed = {
                "email": m.rlike(rf"(?i)(?:\.|dot[\])]\x20?)(?:{'|'.join(DOMAINS.split())})$"), "ip": ~m.rlike(NO_HOSTS), "card": _digits(m).rlike(ISSUERS),
                "phone": F.when(m.startswith("+"), m.rlike(COUNTRY_CODES)).otherwise(m.rlike(AREA_CODES)), "secret": m.rlike(KEYS),
            }
            variety = F.length(F.array_join(F.array_distinct(F.split(F.when(kind == KINDS.index("secret"), m).otherwise(_digits(m)), "")), ""))
            against = before.rlike(_near(AGAINST_BEFORE, False)) | before.rlike(r"(?:#|№|(?i:\bno\.?))\x20?$") | behind.rlike(_near(AGAINST_BEHIND, True))
            strict = F.lit(1) if base else _of_kind(kind, lambda k: flag(m.rlike(STRICT[k]), 1, 0) if k in STRICT else None, F.lit(-1))
            shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]", "9")
            word = lambda text, at: F.xxhash64(F.lower(F.regexp_extract(text, at, 1)), kind)
            return F.struct(
                kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), strict.alias("pattern"),
                flag(_of_kind(kind, lambda k: before.rlike(_near(BEFORE[k], False)), F.lit(False)), 1, -1).alias("before"),
                flag(_of_kind(kind, lambda k: behind.rlike(_near(BEHIND[k], True)), F.lit(False)), 1, -1).alias("behind"), flag(against, 0, -1).alias("against"),
                F.when(_of_kind(kind, listed.get, F.lit(False)), 1).when(kind == KINDS.index("secret"), -1).otherwise(0).alias("gazetteer"), F.when(kind == 0, F.lit(-1)).otherwise(flag(variety >= 3, 1, 0)).alias("shape"),
                F.pmod(F.xxhash64(F.regexp_replace(shape, "([9Aa])\\1{4,}", "$1+"), kind), F.lit(SHAPES)).cast("int").alias("form"),
                F.pmod(word(before, r"(\w+)\W*$"), F.lit(WORDS)).cast("int").alias("left"), F.pmod(word(behind, r"^\W*(\w+)"), F.lit(WORDS)).cast("int").alias("right"),
            )

        return one

    spans = F.concat(F.transform("base", votes(True)), F.transform("more", votes(False)))
    return annotated.withColumn("spans", F.when(F.size("base") + F.size("more") > 0, spans).otherwise(F.expr(f"CAST(array() AS array<{VOTED}>)"))).drop("base", "more")


def patterns(rows: DataFrame) -> list[tuple[tuple, int]]:
    """((kind, votes...), count) over all spans."""
    keys = ["kind", *VOTES]
    counted = rows.select(F.explode("spans").alias("s")).select(*[F.col(f"s.{k}").alias(k) for k in keys]).groupBy(*keys).count()
    return sorted((tuple(r[k] for k in keys), r["count"]) for r in counted.collect())


def reliabilities(counted: list[tuple[tuple, int]], rounds: int = 40, held: float = 20.0) -> tuple[dict, list[float]]:
    """({(kind, labeler): shares of each vote among personal data and among others}, P(personal) of each pattern) by expectation-maximisation.

    Having no opinion is a vote like the others: a labeler that only ever votes against says something by its silence.
    Shares begin at what ACCURACY states and are held there by the weight of ``held`` votes. PROPOSED of the
    proposals are thought personal data: an estimated share would grow without end where few labelers have an opinion.
    """
    totals: dict = {}
    for key, c in counted:
        for j, v in enumerate(key[1:]):
            own = totals.setdefault((key[0], j), {1: 0, 0: 0, -1: 0})
            own[v] += c
    start: dict = {}
    for (k, j), own in totals.items():
        silent, right = (own[-1] + 1) / (sum(own.values()) + 3), ACCURACY[VOTES[j]]
        start[k, j] = tuple({1: (1 - silent) * a, 0: (1 - silent) * (1 - a), -1: silent} for a in (right, 1 - right))
    shares, kinds = dict(start), sorted({key[0] for key, _ in counted})
    belief: list[float] = []
    for _ in range(rounds):
        belief = []
        for key, _ in counted:
            z = math.log(PROPOSED / (1 - PROPOSED))
            for j, v in enumerate(key[1:]):
                yes, no = shares[key[0], j]
                z += math.log(yes[v] / no[v])
            belief.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        for k in kinds:
            rows = [(key, c, q) for (key, c), q in zip(counted, belief) if key[0] == k]
            for j in range(len(VOTES)):
                made = []
                for side, begin in enumerate(start[k, j]):
                    n = {v: held * p for v, p in begin.items()}
                    for key, c, q in rows:
                        n[key[1 + j]] += c * (1 - q if side else q)
                    made.append({v: x / sum(n.values()) for v, x in n.items()})
                shares[k, j] = tuple(made)
    return shares, belief


FEATURES = ["kind", *VOTES, "form", "left", "right"]
#: Where the weights of a feature begin: kind, a weight a vote, then the buckets.
_FORM = 1 + len(KINDS) + len(VOTES)
_LEFT, _RIGHT, _SIZE = _FORM + SHAPES, _FORM + SHAPES + WORDS, _FORM + SHAPES + 2 * WORDS


def _design(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of each row's inputs: bias, kind, votes as 1, -1 or 0, form, neighbour words."""
    r = np.array(rows, np.int64).reshape(-1, len(FEATURES))
    votes = r[:, 1 : 1 + len(VOTES)]
    places = np.column_stack([np.zeros(len(r), np.int64), 1 + r[:, 0], np.broadcast_to(1 + len(KINDS) + np.arange(len(VOTES)), votes.shape), _FORM + r[:, -3], _LEFT + r[:, -2], _RIGHT + r[:, -1]])
    values = np.ones(places.shape)
    values[:, 2 : 2 + len(VOTES)] = (votes == 1) * 1.0 - (votes == 0) * 1.0
    return places, values


def train(rows: list[tuple], counts: list[int], belief: list[float], rounds: int = 200, held: float = 1e-3) -> np.ndarray:
    """Weights of the span classifier: logistic regression on feature rows, weighted by count, with EM's beliefs as labels."""
    w, seen = np.zeros(_SIZE), np.full(_SIZE, 1e-8)
    if not rows:
        return w
    places, values = _design(rows)
    share, truth = np.array(counts, float) / sum(counts), np.array(belief)
    for _ in range(rounds):
        z = np.clip((w[places] * values).sum(1), -30, 30)
        error = (1 / (1 + np.exp(-z)) - truth) * share
        g = np.bincount(places.ravel(), (values * error[:, None]).ravel(), _SIZE) + held * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def probability_logit(w: np.ndarray, s: Column) -> Column:
    """The classifier's logit of a voted span."""
    weights = lambda low, high: F.array(*[F.lit(float(x)) for x in w[low:high]])
    z = F.lit(float(w[0])) + F.element_at(weights(1, 1 + len(KINDS)), s["kind"] + 1)
    for name, x in zip(VOTES, w[1 + len(KINDS) : _FORM]):
        z = z + F.when(s[name] == 1, F.lit(float(x))).when(s[name] == 0, F.lit(float(-x))).otherwise(0.0)
    z = z + F.element_at(weights(_FORM, _LEFT), s["form"] + 1)
    return z + F.element_at(weights(_LEFT, _RIGHT), s["left"] + 1) + F.element_at(weights(_RIGHT, _SIZE), s["right"] + 1)


def accepted(w: np.ndarray):
    """A predicate on a voted span: base spans stay, others need a probability of 0.5 or more."""
    return lambda s: s["base"] | (probability_logit(w, s) >= 0)


def fit(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """The classifier's weights: reliabilities come from all spans, the classifier from at most ``sample_rows`` kinds of feature rows by smallest hash."""
    counted = patterns(rows)
    belief = {key: q for (key, _), q in zip(counted, reliabilities(counted)[1])}
    each = table(rows.select(F.explode("spans").alias("s")).select(*[F.col(f"s.{k}").alias(k) for k in FEATURES]).groupBy(*FEATURES).count(), "features")
    # thinned by hash before they are ranked by it, so that no task sends many: proposals of all kinds have the same chance
    span, h = 1 << 40, F.xxhash64(*FEATURES)
    cut = min(span, int(span * 1.5 * sample_rows / max(1, each.count())) + 1)
    sample = [tuple(r) for r in each.where(F.pmod(h, F.lit(span)) < cut).orderBy(F.pmod(h, F.lit(span)), *FEATURES).limit(sample_rows).collect()]
    return train([r[:-1] for r in sample], [r[-1] for r in sample], [belief[r[: 1 + len(VOTES)]] for r in sample])


def personal_data(documents: DataFrame) -> DataFrame:
    """For each row of ``documents``: doc_id, base and spans, both arrays of (kind, start, end) by start, then kind.

    Whole texts are read; a null text counts as empty, and neither has spans. ``base`` are the valid leftmost matches of the
    base patterns; ``spans`` adds accepted proposals, which never overlap a base span. Repeated rows repeat; other
    columns are ignored; an empty table gives no rows.
    """
    rows = table(voted(annotate(documents)).select("doc_id", "spans"), "spans")
    keep = accepted(fit(rows))
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    ordered = rows.withColumn("spans", F.array_sort(F.filter("spans", keep), _by_start))
    return ordered.select("doc_id", F.transform(F.filter("spans", lambda s: s["base"]), plain).alias("base"), F.transform("spans", plain).alias("spans"))


def named(spans: Column) -> Column:
    """'kind:start:end' of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(documents: DataFrame) -> DataFrame:
    """``documents`` with each accepted span of ``text`` replaced by its kind in square brackets and n_chars, if there, set anew.

    Overlapping spans of several kinds become one, named after the first. Null texts stay null, empty ones empty. Repeated
    rows repeat; other columns stay as they are; an empty table stays empty. The texts are searched once: what was found is
    written beside them, and the classifier fitted on it, before anything is replaced.
    """
    rows = table(voted(annotate(documents)), "found")
    keep = accepted(fit(rows))
    rows = rows.withColumn("spans", F.array_sort(F.filter("spans", keep), _by_start))
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        ahead = s["start"] >= acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.element_at(tags, s["kind"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(ahead, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rows = rows.withColumn("_done", F.when(F.size("spans") > 0, done))
    text = F.when(F.col("_null"), None).when(F.col("_done").isNull(), F.col("text")).otherwise(F.concat(F.col("_done.out"), F.substring(F.col("text"), F.col("_done.at") + 1, F.length("text"))))
    rows = rows.withColumn("_text", text)
    length = F.when(F.col("_done").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else None
    return rows.select(*[F.col("_text").alias("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"_row.`{c}`").alias(c) for c in documents.columns])
