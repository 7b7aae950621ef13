"""Personal data in whole texts, with DataFrame operations only.

Regular expressions propose spans per kind (leftmost, not overlapping within a kind), checksums and value
ranges confirm them (a failing match is dropped, never retried), and words near a span move its score, which must
reach a least one where the kind has one.
Offsets count code points, the end exclusive. They come from the lengths of the matches and of the gaps
between them, so a text is scanned twice per kind however many matches it has.

The patterns are written with possessive quantifiers and look-behinds where that leaves the matches as they
are: run time stays linear in the text and no match recurses, whatever its length.

Nulls and ties: a null text counts as empty and has no spans; a null doc_id keeps its row; repeated rows stay
repeated. Spans that start together are ordered by kind as listed. find_pii() replaces a column pii; redact() leaves a
null text null and keeps all columns as they are; of spans that overlap, it names the one that starts first.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolark.llm.common import packed


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # SQL predicate over a text ``t`` without which no match is possible
    valid: str  # SQL predicate over a match ``m``
    score: float
    near: tuple[str, ...]  # words nearby that raise the score
    far: tuple[str, ...] = ()  # words nearby that lower it
    least: float = 0.0  # score that a span needs


DIGITS = "regexp_replace(m, '[^0-9]', '')"
#: Luhn: every second digit from the right is doubled and its digits are summed.
LUHN = f"aggregate(sequence(1, length({DIGITS})), 0, (s, i) -> s + if(i % 2 = 0, element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), int(substr({DIGITS}, -i, 1)) + 1), int(substr({DIGITS}, -i, 1)))) % 10 = 0"
COMPACT = "concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4))"
#: Mod 97: letters count as 10 to 35 and the number, first four characters last, leaves 1.
MOD97 = f"aggregate(sequence(1, length({COMPACT})), 0, (r, i) -> if(substr({COMPACT}, i, 1) <= '9', (r * 10 + int(substr({COMPACT}, i, 1))) % 97, (r * 100 + ascii(substr({COMPACT}, i, 1)) - 55) % 97)) = 1"

#: Length of an IBAN by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
SIZED = "concat(substr(m, 1, 2), length(replace(m, ' ', ''))) in (" + ", ".join(f"'{x}'" for x in IBAN_LENGTHS.split()) + ")"

#: The four base kinds in the order of ties, then what the method adds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true", 0.8, ("mail", "contact", "write", "@")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains(t, '.')", "forall(split(m, '[.]'), p -> length(ltrim('0', p)) <= 3 and int(concat('0', substr(ltrim('0', p), 1, 3))) <= 255)", 0.6, ("ip", "host", "server", "address"), ("version", "release")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "t is not null", f"length({DIGITS}) between 12 and 19 and if(length({DIGITS}) between 12 and 19, {LUHN}, false)", 0.7, ("card", "credit", "visa", "payment"), ("isbn", "order", "tracking")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains(t, '+')", f"length({DIGITS}) between 9 and 15", 0.6, ("phone", "call", "tel", "mobile")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])", "t rlike '[A-Z]{2}[0-9]{2}'", f"{SIZED} and {MOD97}", 0.7, ("iban", "bank", "account", "konto"), ("order", "tracking", "serial", "part"), 0.7),
)
BASE = ("email", "ip", "card", "phone")

#: Code points looked at on either side of a span, and what a word found there adds or takes.
CONTEXT, SHIFT = 40, 0.2


def sql_text(value: str) -> str:
    return "r'" + value + "'"


def has_word(words: tuple[str, ...]) -> str:
    return " or ".join(f"contains(near, '{w}')" for w in words) or "false"


SPAN = "struct<start: int, rank: int, end: int, kind: string, text: string, score: double>"


def bound(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, evaluated once however often body mentions it or a filter repeats it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def spans_of(kind: Kind, rank: int) -> str:
    """SQL over t, a text, of the confirmed spans of a kind."""
    none, pattern = f"cast(array() as array<{SPAN}>)", sql_text(kind.pattern)
    # Starts of the matches: running lengths of the gaps and matches before.
    starts = """aggregate(sequence(0, size(x.m) - 1), named_struct('at', 0, 'all', cast(array() as array<int>)),
        (s, i) -> named_struct('at', s.at + length(x.g[i]) + length(x.m[i]), 'all', array_append(s.all, s.at + length(x.g[i]))), s -> s.all)"""
    score = f"round(least(1.0D, {kind.score}D + if({has_word(kind.near)}, {SHIFT}D, 0D) - if({has_word(kind.far)}, {SHIFT}D, 0D)), 3)"
    near = f"translate(concat(right(x.g[i], {CONTEXT}), ' ', left(x.g[i + 1], {CONTEXT})), '{ascii_uppercase}', '{ascii_lowercase}')"
    span = f"named_struct('start', p[i], 'rank', {rank}, 'end', p[i] + length(m), 'kind', '{kind.name}', 'text', m, 'score', {bound(near, 'near', score)})"
    spans = bound(starts, "p", f"filter(transform(x.m, (m, i) -> if({kind.valid}, {span}, null)), s -> s.score >= {kind.least}D)")
    found = bound(f"named_struct('m', ms, 'g', split(t, {pattern}, -1))", "x", spans)
    return f"if({kind.hint}, {bound(f'regexp_extract_all(t, {pattern}, 0)', 'ms', f'if(size(ms) > 0, {found}, {none})')}, {none})"


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with pii: array of (start, rank, end, kind, text, score) ordered by start, then kind."""
    every = "array_sort(concat(" + ", ".join(spans_of(k, i) for i, k in enumerate(kinds)) + "))"
    return docs.withColumn("pii", F.expr(bound("coalesce(text, '')", "t", every)))


def joined(pii: Column) -> Column:
    return F.concat_ws(",", F.transform(pii, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """find_pii()'s spans as counts, the hash of the base spans, and all spans and their scores (in hundredths) as text."""
    base = F.filter("pii", lambda s: s.kind.isin(*BASE))
    counts = [F.expr(f"cast(size(filter(pii, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE]
    scores = F.concat_ws(",", F.transform("pii", lambda s: F.round(s.score * 100).cast("int").cast("string")))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"), scores.alias("scores"))


#: SQL over text and pii: the text with each run of overlapping spans replaced by the kind of the first, in brackets.
REDACTED = """if(size(pii) = 0, text, get(transform(array(struct(
    regexp_extract_all(text, '(?s).', 0) as signs,
    aggregate(pii, cast(array() as array<struct<start: int, end: int, kind: string>>), (kept, s) -> if(size(kept) > 0 and s.start < element_at(kept, -1).end,
        concat(slice(kept, 1, size(kept) - 1), array(named_struct('start', element_at(kept, -1).start, 'end', greatest(s.end, element_at(kept, -1).end), 'kind', element_at(kept, -1).kind))),
        array_append(kept, named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))) as kept)), x -> concat(
    array_join(transform(x.kept, (s, i) -> concat(array_join(slice(x.signs, if(i = 0, 0, x.kept[i - 1].end) + 1, s.start - if(i = 0, 0, x.kept[i - 1].end)), ''), '[', upper(s.kind), ']')), ''),
    array_join(slice(x.signs, element_at(x.kept, -1).end + 1, size(x.signs)), ''))), 0))"""


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, length: str | None = None) -> DataFrame:
    """docs with find_pii()'s spans of ``text`` replaced by their kind in brackets.

    length: a column that becomes the number of code points of texts that change.
    """
    rows = find_pii(packed(docs, "text"), kinds).withColumn("text", F.expr(REDACTED))
    new = {"text": F.col("text").alias("text")}
    if length:
        old = F.col("row_")[length]
        new[length] = F.when(F.size("pii") > 0, F.length("text").cast(dict(docs.dtypes)[length])).otherwise(old).alias(length)
    return rows.select(*[new.get(c, F.col("row_")[c].alias(c)) for c in docs.columns])
