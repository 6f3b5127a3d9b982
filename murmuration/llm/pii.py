"""Personal data: candidate spans from wide generators, boosted trees, calibrated thresholds.

DataFrame functions do all work on rows; the trees are fitted to counts of all labelled spans.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boosting import Booster, Held, Spread
from .common import Scratch, keyed

KINDS = ("email", "ip", "card", "phone")
#: Only the trees find these, after the base kinds in every order.
SECRET = len(KINDS)
NAMES = (*KINDS, "secret")

# The base patterns, written so that Java's matcher neither recurses once a character nor starts again inside a run: runs
# are possessive, a match starts at a run's begin or where the last match ended (\G), and groups that would repeat are
# spelt as a class and a look at what follows.
_LABEL = "[A-Za-z0-9-]"
_BASE = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@{_LABEL}++\.{_LABEL}[A-Za-z0-9.-]*?(?=\.(?!{_LABEL})|(?![A-Za-z0-9.-]))",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[\x200-9-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider ones: addresses with a spelt-out sign, numbers without a country, long groups of digits, addresses with a port, and
# runs that could be keys. Lengths are those that the formats allow.
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20at\x20|\x20?@\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,3}\x20?[.]\x20?[0-9]{1,3}\x20?[.]\x20?[0-9]{1,3}\x20?[.]\x20?[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[\x20.-]{0,2}[0-9]{4}[\x20.-]{0,2}[0-9]{4}[\x20.-]{0,2}[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
_OCTET = "0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
_WORDS = r"(?i)(?:card|visa|phone|tel|call|mobile|fax|mail|contact|address|host|server|ip)[^A-Za-z0-9]*$"
#: What a confirmed number has before its national part, and an unconfirmed one may have.
_PREFIX = r"(?:\+[0-9]{1,3}|(?<![0-9.-])1)[\x20().-]{0,3}$"
#: What names a key before it: an assignment or a scheme.
_NAMED = r"(?i)(?:token|secret|passwo?r?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth|bearer)s?[\x22\x27]?\s*[:=]{0,2}\s*[\x22\x27]?$"
#: Characters kept on either side of a span as context.
CONTEXT = 24
#: Distinct feature tuples that the driver holds; of more, it gets the trees' sums alone. The labelled spans all count.
DRIVER_TUPLES = 50_000
#: The share of found spans that must be labelled for a threshold to hold, and the labelled spans that it takes.
PRECISION, LEAST_POSITIVE = 0.98, 20


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check that doubles every second digit from the right."""
    places = F.split(F.reverse(digits), "(?<=.)(?=.)")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def _spans_of(pattern: str, kind: int, wide: bool) -> Column:
    """For each match in order: what precedes it since the last one, in code points, the match, and its surroundings.

    The text between matches comes from a split by the same pattern. Prefix sums, taken later over a document's rows, turn
    the gaps into places.
    """
    text = F.col("text")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(found.alias("match"), gaps.alias("gap"), F.slice(gaps, 2, 1 << 30).alias("next"))
    rows = F.transform(
        F.filter(pairs, lambda x: x.match.isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), i.alias("i"), F.length(x.gap).alias("gap"), x.match.alias("match"),
            F.substring(x.gap, -CONTEXT, CONTEXT).alias("before"), F.substring(x.next, 1, CONTEXT).alias("after"),
        ),
    )
    return rows


def _candidates(source: DataFrame, scratch: Scratch) -> DataFrame:
    """Matches of all patterns with their places; a row without kind for a document with none."""
    has_digit, has_at = F.col("text").rlike("[0-9]"), F.col("text").rlike("@|(?i:at[^A-Za-z0-9]|at$)")
    none = F.array().cast("array<struct<kind: int, wide: boolean, i: int, gap: int, match: string, before: string, after: string>>")
    found = [
        F.when(has_at if kind == "email" else has_digit, _spans_of(patterns[kind], k, wide)).otherwise(none)
        for wide, patterns in ((False, _BASE), (True, _WIDE))
        for k, kind in enumerate(patterns)
    ]
    rows = source.select("key", "doc_id", F.explode_outer(F.concat(*found)).alias("c")).select("key", "doc_id", "c.*")
    rows = scratch.write(rows, "matches").repartition("key")
    so_far = Window.partitionBy("key", "wide", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.length("match")).over(so_far)
    return rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("match"))


def _described(rows: DataFrame) -> DataFrame:
    """Adds whether a base match holds, whether a wide one passes its kind's checks, and the features of every span.

    Features are those of the span as a base match would have it: signs and dots that are spelt out, blanks and the
    separators of cards are undone, and a number's country code is no part of its context. So no feature tells a span
    that a base match confirms from one that only its format keeps from that. The checks themselves are no features.
    """
    match, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octets = lambda c: c.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    card = n.between(16, 19) & F.when(n.between(16, 19), _luhn(digits)).otherwise(False)
    holds = F.when(kind == 0, True).when(kind == 1, octets(match)).when(kind == 2, card).otherwise(n.between(8, 15))

    dotted = F.regexp_replace(match, r"(?i)\x20?[\[(]dot[\])]\x20?|\x20dot\x20", ".")
    address = F.regexp_replace(dotted, r"(?i)\x20?[\[(]at[\])]\x20?|\x20at\x20|\x20?@\x20?", "@")
    plain = F.when(kind == 0, address).when(kind == 1, F.regexp_replace(match, r"\x20", "")).when(kind == 2, digits).otherwise(match)
    letters = F.length(F.regexp_replace(match, "[^A-Za-z]", ""))
    # of a short or long key alike: letters and digits mixed, and not a few characters over and over
    mixed = (letters * 8 >= F.length(match)) & (n * 8 >= F.length(match)) & (F.size(F.array_distinct(F.split(F.substring(match, 1, 64), "(?<=.)(?=.)"))) >= 8)
    before = F.when(kind == 3, F.regexp_replace("before", _PREFIX, "")).otherwise(F.col("before"))
    after = F.coalesce("after", F.lit(""))
    glued_before, glued_after = before.rlike("[A-Za-z0-9]$"), after.rlike("^[A-Za-z0-9]")
    alone = ~glued_before & ~glued_after & ~before.rlike(r"[0-9][\x20.-]$") & ~after.rlike(r"^[\x20.-][0-9]")
    valid = F.when(kind == 0, plain.rlike(r"\.[A-Za-z]{2,}$")).when(kind == 1, octets(plain)).when(kind == 2, card).when(kind == SECRET, mixed).otherwise(alone)
    # "look at a.b" is prose as often as an address
    clear = (kind != 0) | match.rlike(r"(?i)@|[\[(]at[\])]|\x20dot\x20|[\[(]dot[\])]")

    count = lambda pattern: F.regexp_count(plain, F.lit(pattern))
    features = {
        "f_kind": kind,
        "f_length": F.length(plain),
        "f_digits": n,
        "f_blanks": count(r"\x20"),
        "f_dots": count(r"\."),
        "f_dashes": count("-"),
        "f_brackets": count(r"[()\[\]]"),
        "f_first_digit": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)),
        "f_glued_before": glued_before,
        "f_glued_after": glued_after,
        "f_word_before": before.rlike(_WORDS),
        "f_letters": letters,
        "f_capitals": F.length(F.regexp_replace(match, "[^A-Z]", "")),
        "f_hex": match.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
    }
    named = (kind == SECRET) & before.rlike(_NAMED)
    described = rows.withColumns({"holds": ~F.col("wide") & holds, "valid": F.col("wide") & valid, "clear": F.col("wide") & clear, "named": F.col("wide") & named})
    # large counts on a scale of 16 steps to a doubling, so that a feature has some 600 values at most
    level = lambda v: F.when(v <= 256, v).otherwise(F.floor(16 * F.log2(v)).cast("int") + 128)
    return described.withColumns({k: level(v.cast("int")) for k, v in features.items()})


def _against_base(rows: DataFrame) -> DataFrame:
    """Adds to wide spans whether a base match that holds overlaps them (touched), and whether one of their own kind does, or
    for a key the words before it name it (confirmed); the former by running ends and starts in a document."""
    here = Window.partitionBy("key").orderBy("start", "end", "wide", "kind")
    earlier, later = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(1, Window.unboundedFollowing)

    def overlapped(base):
        ended, begins = F.max(F.when(base, F.col("end"))).over(earlier), F.min(F.when(base, F.col("start"))).over(later)
        return F.coalesce(ended > F.col("start"), F.lit(False)) | F.coalesce(begins < F.col("end"), F.lit(False))

    confirmed = F.col("named")
    for k in range(len(KINDS)):
        confirmed = confirmed | ((F.col("kind") == k) & overlapped(F.col("holds") & (F.col("kind") == k)))
    return rows.withColumns({"touched": overlapped(F.col("holds")), "confirmed": confirmed})


def _half() -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2)).cast("int")


def _model(rows: DataFrame, scratch: Scratch) -> list[tuple[Booster, dict[int, float]]] | None:
    """For each half of the documents: trees that all labelled spans of the other half trained, and for each kind the least
    calibrated probability that keeps PRECISION on all labelled spans of the half itself.

    Labels come from the base rules: a wide span is positive if a base match of its kind that holds overlaps it, and
    negative if a match of another kind does or if it fails its kind's checks. A key is positive if it is named, which no
    feature shows. The rest, which may be added too, have no label: they neither train nor calibrate. Every labelled span
    trains one half's trees and calibrates the other's, so no span is judged by trees that its document has trained.

    Spans are counted by feature tuple in the cluster. The driver gets the counts if there are DRIVER_TUPLES at most, else
    the sums that each level of a tree needs; then counts by kind and score.
    """
    names = [c for c in rows.columns if c.startswith("f_")]
    wide = rows.filter("wide AND (touched OR named OR NOT valid)")
    counted = wide.groupBy(_half().alias("half"), *names).agg(F.count("*").alias("n"), F.sum(F.col("confirmed").cast("long")).alias("positive"))
    counted = scratch.write(counted, "counted")
    tuples = counted.count()
    if not tuples:
        return None
    table = np.array([[int(v) for v in r] for r in counted.collect()], np.int64) if tuples <= DRIVER_TUPLES else None
    models = []
    for half in (0, 1):
        if table is not None:
            t = table[table[:, 0] != half]
            source = Held({c: t[:, i + 1] for i, c in enumerate(names)}, t[:, -1].astype(float), t[:, -2].astype(float)) if len(t) else None
        else:
            part = counted.filter(F.col("half") != half)
            source = Spread(part, names, scratch, f"scores{half}-") if part.limit(1).count() else None
        if source and source.positive:
            booster = Booster.grown(source)
            models.append((booster, _thresholds(booster, counted.filter(F.col("half") == half))))
        else:
            models.append((Booster(0.0, []), {}))
    return models


def _thresholds(booster: Booster, counted: DataFrame) -> dict[int, float]:
    """Calibrates the trees on counted spans and gives each kind's threshold on them."""
    by_score = counted.groupBy("f_kind", booster.score_column().alias("score")).agg(F.sum("n"), F.sum("positive"))
    rows = sorted(map(tuple, by_score.collect()))
    if not rows:
        return {}
    kind, score, n, yes = (np.array(c, float) for c in zip(*rows, strict=True))
    booster.calibrate_scores(np.repeat(score, 2), np.tile([1.0, 0.0], len(n)), np.stack([yes, n - yes], 1).reshape(-1))
    p = booster.probability_at(score)
    thresholds = {}
    for k in range(len(NAMES)):
        own = np.flatnonzero(kind == k)
        order = own[np.argsort(-p[own], kind="stable")]
        good, all_, ps = np.cumsum(yes[order]), np.cumsum(n[order]), p[order]
        last = np.append(ps[1:] != ps[:-1], True) if len(ps) else np.zeros(0, bool)
        fit = np.flatnonzero(last & (good >= PRECISION * all_) & (good >= LEAST_POSITIVE))
        if len(fit):
            thresholds[k] = float(ps[fit[-1]]) - 1e-9
    return thresholds


def find_spans(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text: all base matches that hold, and wide candidates that the trees accept.

    Base matches are leftmost and do not overlap within a kind; those that fail their check go, and nothing is tried in
    their place. A wide candidate is added if it passes its kind's checks, its calibrated probability reaches its kind's
    threshold and it overlaps neither a base match nor an added span before it; an address with a plain "at" also needs
    its dots or its sign to be spelt as such. Places are code points, ends exclusive. Only matches are shuffled.

    Null and empty texts have no spans, and the matcher's work and stack are bounded in a text of any length. Rows that
    share an id or have none are kept apart as read. Other columns are not read; an empty table gives no rows.

    Returns key, doc_id (a row for each text at least), kind, start, end, base; kind is null for a text without spans. Kinds
    count through NAMES: the last one, keys and tokens, is of added spans alone.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    return _found(_source(docs, scratch), scratch)


def _source(docs: DataFrame, scratch: Scratch) -> DataFrame:
    return keyed(docs, scratch).withColumn("text", F.col("text").cast("string"))


def _found(source: DataFrame, scratch: Scratch) -> DataFrame:
    rows = scratch.write(_against_base(_described(_candidates(source, scratch))), "described")
    scratch.drop("matches")
    models = _model(rows, scratch)
    added = F.lit(False)
    if models and any(thresholds for _, thresholds in models):
        kept = [(_half() == half) & (F.col("kind") == k) & (F.col("probability") >= t) for half, (_, thresholds) in enumerate(models) for k, t in thresholds.items()]
        enough = reduce(lambda a, b: a | b, kept)
        may = F.col("wide") & ~F.col("touched") & F.col("valid") & F.col("clear")
        rows = rows.withColumn("probability", F.when(may & (_half() == 0), models[0][0].column()).when(may, models[1][0].column()))
        chosen = F.coalesce(may & enough, F.lit(False))
        rows = rows.withColumn("chosen", chosen)
        here = Window.partitionBy("key").orderBy("start", "end", "wide", "kind").rowsBetween(Window.unboundedPreceding, -1)
        clear = F.coalesce(F.max(F.when(F.col("chosen"), F.col("end"))).over(here) <= F.col("start"), F.lit(True))
        added = F.col("chosen") & clear
    spans = rows.withColumn("added", added).filter("kind IS NULL OR holds OR added OR i = 0")
    # a text's first match of each kind stays as a row without kind, so that every text has a row
    real = F.coalesce(F.col("holds") | F.col("added"), F.lit(False))
    return spans.select("key", "doc_id", *(F.when(real, F.col(c)).alias(c) for c in ("kind", "start", "end")), F.col("holds").alias("base"))


def summarise(spans: DataFrame) -> DataFrame:
    """Per text: counts of base spans by kind, the digest of the base spans' list, the list of all spans, and counts of all
    spans, of those added and of keys among them."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("kind") + 1)
    shown = F.struct("kind", "start", "end", F.concat_ws(":", name, "start", "end").alias("shown"))
    base = F.when(F.col("base") & F.col("kind").isNotNull(), shown)
    any_ = F.when(F.col("kind").isNotNull(), shown)
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x.shown), ",")
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    added = F.count(F.when(~F.col("base") & F.col("kind").isNotNull(), 1)).alias("n_added")
    secret = F.count(F.when(F.col("kind") == SECRET, 1)).alias("n_secret")
    out = spans.groupBy("key", "doc_id").agg(*counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(any_).alias("spans"), F.count("kind").alias("n_spans"), added, secret)
    return out.drop("key")


def redact(docs: DataFrame, mark: str = "<{kind}>") -> DataFrame:
    """doc_id and text with every span replaced by its mark, of each row; rows with one id, or without, keep their own."""
    scratch = Scratch(docs.sparkSession, "redact")
    source = _source(docs, scratch)
    spans = _found(source, scratch).filter("kind IS NOT NULL")
    ends = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end").over(ends), F.lit(0))
    marks = F.element_at(F.array(*(F.lit(mark.format(kind=k)) for k in NAMES)), F.col("kind") + 1)
    cuts = spans.withColumn("from", before).filter(F.col("end") > F.col("from"))
    cuts = cuts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.greatest("start", "from").alias("start"), "from", "end", marks.alias("mark")))).alias("cuts"))
    text = F.col("text")
    kept = F.transform("cuts", lambda c: F.concat(F.substring(text, c["from"].cast("int") + 1, (c.start - c["from"]).cast("int")), F.when(c.start >= c["from"], c.mark)))
    last = F.element_at("cuts", -1).end.cast("int")
    whole = F.concat(F.array_join(kept, ""), F.substring(text, last + 1, 1 << 30))
    return source.join(cuts, "key", "left").select("doc_id", F.when(F.col("cuts").isNull(), text).otherwise(whole).alias("text"))
