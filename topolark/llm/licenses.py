"""License scan, with DataFrame operations only.

What of a text may state a license is compared with every template by the cosine of sparse TF-IDF vectors: terms
are runs of letters and digits with inner dots, inverse document frequencies come from the templates, and terms
unknown to them weigh most, so that prose around a notice lowers its score. Compared are, each as a vector,

* one to WINDOW adjacent lines that mention a license (MENTION), as notices come alone or wrapped,
* paragraphs that mention one, where lines without letters and digits, such as a bare comment sign, part them,
* the comment that a text begins with, whatever it says,
* the whole text of a license file (LICENSE, COPYING, NOTICE and the like).

Statements are read as well: SPDX expressions to the end of their line, and sentences ("Dual licensed under MIT and
Apache 2.0.") of at most 400 code points behind "under". Each name in them is compared with the names of licenses in
the same way, and a statement counts only if all of its names reach NAME_LEAST and, for SPDX, its words stand in an
order that the syntax allows (parentheses only have to match in number); one that does not count states nothing. Its score is that of its worst name. Several
names make an expression: as written in SPDX; for a sentence the distinct ids in order, joined by OR if it is dual
or offers a choice, else by AND.

A file's own license is its best SPDX expression or choice of several names, else the best of single statements and
of templates at or above ``least``. A file without one inherits from its nearest
ancestor directory with a license file that has a license of its own, found by joins on paths of directories.

Scoring happens inside the row, without a shuffle, in time proportional to the text. For inheritance, license files
are aggregated per directory and directories, not files, are joined with their ancestors.

Paths count from the root with or without a leading slash; "." and empty parts are dropped, ".." is an ordinary
name. The root directory is the empty string.

Nulls and ties: a null or empty text has no notice; a null path has no directory, so it inherits nothing; among
templates of one score the first id wins, among license files of one directory the best score, then the first
id. Repeated rows stay repeated. Columns named like those added are replaced, others pass through.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topolark.llm.common import packed, unpacked
from topolark.llm.license_texts import NAMES, TEMPLATES

LEAST, NAME_LEAST, WINDOW = 0.7, 0.8, 4
TERM = "[a-z0-9]+(?:[.][a-z0-9]+)*"
MENTION = "license|redistribut|permission is|permission to|public domain|creative commons|(?:released|distributed|available|published|provided) under"
#: An SPDX expression and its words; the shape of one: a name is i, "or" and "and" o, "with" w.
SPDX, SPDX_WORD = r"spdx-license-identifier:[ \t]*([^\n]*)", "[()]|[a-z0-9][a-z0-9.+-]*"
SHAPE = r"^\(*i(?:wi)?\)*(?:o\(*i(?:wi)?\)*)*$"
#: A line's end with the comment sign of the next line; a sentence that names licenses; what tells a choice in it.
LINE_END = r"\r?\n[ \t]*(?://+|/\*+|#+|\*+|--|;+|%+|<!--)?[ \t]*"
STATEMENT = r"(?:(?:dual|dually|multi|tri)[- ])?(?:licensed|released|distributed|available|published|provided) under (?s:.){1,400}?(?:[.;](?:[ \t\r]|\z)|\z)"
CHOICE = "^(?:dual|multi|tri)|under either | or |your option"
#: Rewritten in a sentence before its names are split, one after the other, and what splits them.
REWRITES = ((r"^.*? under ", ""), (r"\(?at your (?:own )?option\)?", ""), (r",? or +(?:any )?later(?: version)?", " or-later"), (r"\([^()]*\)", " ; "), (r"(?:either of|either|both) |the terms of ", ""))
SPLIT = r"[;/|]| and/or | or | and |[.](?:[ \t\r]|\z)"
#: Ends of a paragraph, a leading comment line by line, and a leading comment between signs.
GAP = r"\n(?:[^a-z0-9\n]*\n)+"
COMMENT = r"^(?:[ \t]*(?://|/\*|#|\*|--|;|%|<!--)[^\n]*(?:\n|$)|[ \t\r]*\n)+"
BLOCK = r"(?s)^[ \t\r\n]*/\*.*?\*/"
FILES = "(?i)^(?:licen[cs]e|copying|notice|unlicense)(?:[.-].*)?$"


def plain(text: str) -> str:
    return text.lower().replace("licence", "license")


def terms(text: str) -> list[str]:
    return re.findall(TERM, plain(text))


def weights(templates: tuple[tuple[str, str], ...]) -> tuple[dict[str, float], float]:
    """(inverse document frequency of the templates' terms, that of an unknown term)."""
    seen = Counter(t for _, text in templates for t in set(terms(text)))
    total = len(templates)
    return {t: math.log((1 + total) / (1 + n)) + 1 for t, n in sorted(seen.items())}, math.log(1 + total) + 1


def possessive(pattern: str) -> str:
    """The pattern with repetitions that never give back: matching takes no recursion, whatever the text's length."""
    return re.sub(r"(?<=[\])])([+*])(?![+?])", r"\1+", pattern)


def bound(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def scored(templates: tuple[tuple[str, str], ...], least: float) -> str:
    """SQL over t, the terms of a notice: the (score, license) of its best template, or null below least."""
    idf, unknown = weights(templates)
    known = ", ".join(f"'{t}'" for t in idf)
    rows: dict[str, list[float]] = {t: [0.0] * len(templates) for t in idf}
    for k, (_, text) in enumerate(templates):
        counts = Counter(terms(text))
        length = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
        for t, n in counts.items():
            rows[t][k] = n * idf[t] ** 2 / length
    table = f"from_json('{json.dumps({t: [w, *rows[t]] for t, w in idf.items()})}', 'map<string, array<double>>')"
    # Sums of squares over sorted terms, of all and of the known: a run of equal terms adds (length * idf) squared when it ends.
    every, own = "s.sum + pow(s.run * s.idf, 2)", "s.own + if(s.known, pow(s.run * s.idf, 2), 0D)"
    state = "named_struct('last', {}, 'run', {}, 'idf', {}, 'known', {}, 'sum', {}, 'own', {})".format
    start = bound(f"if(x in ({known}), weights[x][0], null)", "i", state("x", "1D", f"coalesce(i, {unknown!r}D)", "i is not null", every, own))
    more = state("s.last", "s.run + 1", "s.idf", "s.known", "s.sum", "s.own")
    sums = f"aggregate(array_sort(t), {state("''", '0D', '0D', 'false', '0D', '0D')}, (s, x) -> if(x = s.last, {more}, {start}), s -> named_struct('sum', {every}, 'own', {own}))"
    # No cosine exceeds the known terms' share of the length, so most texts end here.
    dots = f"aggregate(t, array_repeat(0D, {len(templates)}), (s, x) -> if(x in ({known}), zip_with(s, slice(weights[x], 2, {len(templates)}), (a, b) -> a + b), s))"
    names = "array(" + ", ".join(f"'{name}'" for name, _ in templates) + ")"
    fits = f"array_sort(zip_with({dots}, {names}, (d, n) -> named_struct('score', -round(d / sqrt(n2.sum), 6), 'license', n)))"
    first = bound(f"{fits}[0]", "f", f"if(f.score <= {-least}D, f, null)")
    some = bound(sums, "n2", f"if(n2.own >= {least * least - 1e-6}D * n2.sum and n2.sum > 0, {first}, null)")
    return bound(table, "weights", some)


def statements(text: str) -> str:
    """SQL of the statements of a text (lower case): array of (plain: no choice or expression, score: negative, license)."""
    name = lambda word: bound(f"regexp_extract_all({word}, r'{possessive(TERM)}', 0)", "t", scored(NAMES, NAME_LEAST))
    part = "named_struct('shape', '{}', 'score', -1D, 'word', {})".format
    word = bound(name("regexp_replace(v, '[+]$', '-or-later')"), "named", "if(named is null, null, named_struct('shape', 'i', 'score', named.score, 'word', named.license))")
    word = f"case when v in ('or', 'and') then {part('o', 'upper(v)')} when v = 'with' then {part('w', 'upper(v)')} when v = '(' then {part('(', 'v')} when v = ')' then {part(')', 'v')} else {word} end"
    words = f"transform(regexp_extract_all(e, r'{possessive(SPDX_WORD)}', 0), v -> {word})"
    sound = f"shape rlike r'{possessive(SHAPE)}' and length(replace(shape, '(', '')) = length(replace(shape, ')', ''))"
    joined = "replace(replace(array_join(transform(ws, w -> w.word), ' '), '( ', '('), ' )', ')')"
    whole = bound("array_join(transform(ws, w -> w.shape), '')", "shape", f"if({sound}, named_struct('plain', 0, 'score', array_max(transform(ws, w -> w.score)), 'license', {joined}), null)")
    spdx = f"transform(regexp_extract_all({text}, r'{possessive(SPDX)}', 1), e -> {bound(words, 'ws', f'if(exists(ws, w -> w is null), null, {whole})')})"
    rest = "e"
    for old, new in REWRITES:
        rest = f"regexp_replace({rest}, r'{old}', '{new}')"
    names = f"transform(filter(split({rest}, r'{SPLIT}', -1), v -> v rlike '[a-z0-9]'), v -> {name('v')})"
    ids = "array_sort(array_distinct(transform(ws, w -> w.license)))"
    choice = f"named_struct('plain', if(size(ids) > 1, 0, 1), 'score', array_max(transform(ws, w -> w.score)), 'license', array_join(ids, if(e rlike r'{CHOICE}', ' OR ', ' AND ')))"
    some = bound(names, "ws", f"if(size(ws) = 0 or exists(ws, w -> w is null), null, {bound(ids, 'ids', choice)})")
    said = f"transform(regexp_extract_all(regexp_replace({text}, r'{LINE_END}', ' '), r'{STATEMENT}', 0), e -> {some})"
    return f"if({text} rlike '{MENTION}', filter(concat({spdx}, {said}), x -> x is not null), null)"


def notices(text: str, is_file: str) -> str:
    """SQL of the parts of a text (lower case) that may state a license; is_file: SQL, whether the text is a license file's."""
    tells = lambda x: f"{x} rlike '{MENTION}'"
    windows = f"transform(sequence(1, least({WINDOW}, size(lines) - i)), w -> array_join(slice(lines, i + 1, w), '\\n'))"
    lines = bound(f"split({text}, '\\n', -1)", "lines", f"flatten(transform(sequence(0, size(lines) - 1), i -> filter({windows}, x -> {tells('x')})))")
    blocks = f"filter(split({text}, r'{possessive(GAP)}', -1), x -> {tells('x')})"
    heads = f"array(regexp_extract({text}, r'{possessive(COMMENT)}', 0), regexp_extract({text}, r'{BLOCK}', 0))"
    none = "cast(array() as array<string>)"
    return f"array_distinct(concat(if({tells(text)}, concat({lines}, {blocks}), {none}), {heads}, if({is_file}, array({text}), {none})))"


def own_license(text: str, is_file: str = "false", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> Column:
    """(score, license) of the best statement or notice of a text column; null without one at or above the least score."""
    lists = f"transform({notices('low', is_file)}, x -> regexp_extract_all(x, r'{possessive(TERM)}', 0))"
    found = bound(f"array_min(transform({lists}, t -> {scored(templates, least)}))", "f", "if(f is null, null, named_struct('plain', 1, 'score', f.score, 'license', f.license))")
    found = f"array_min(array({found}, array_min({statements('low')})))"
    best = bound(f"replace(lower({text}), 'licence', 'license')", "low", bound(found, "f", "if(f is null, null, named_struct('score', -f.score, 'license', f.license))"))
    return F.expr(f"if({text} is null, null, {best})")


def rooted(path: Column) -> Column:
    """The path from the root, without "." and empty parts."""
    return F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), path), r"/(?:\.?/)*+(?:\.$)?", "/"), "/$", "")


def directory(path: Column) -> Column:
    """Path without its last part; the root is the empty string."""
    return F.regexp_replace(rooted(path), "/[^/]*$", "")


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """files (path, text, ...) with license, score, license_source (own, inherited or none) and license_dir."""
    named = F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(FILES), F.lit(False))
    rows = packed(files, "path", "text", named.alias("named_"), directory(F.col("path")).alias("dir_"))
    rows = rows.select("row_", "dir_", own_license("text", "named_", templates, least).alias("own_"))
    # License files are scored apart, so that no other text is scored twice.
    holders = files.where(named).select(directory(F.col("path")).alias("dir_"), own_license("text", "true", templates, least).alias("own_")).where("own_ is not null")
    order = F.struct((-F.col("own_.score")).alias("s"), F.col("own_.license").alias("license"))
    holders = holders.groupBy(F.col("dir_").alias("holder")).agg(F.min(order).alias("held"))
    steps = F.transform(F.split("dir_", "/"), lambda _, i: F.struct(i.alias("depth"), F.array_join(F.slice(F.split("dir_", "/"), 1, i + 1), "/").alias("above")))
    above = rows.select("dir_").where("dir_ is not null").distinct().select("dir_", F.inline(steps))
    nearest = above.join(holders, above.above == F.col("holder")).groupBy("dir_").agg(F.max_by(F.struct("holder", "held"), "depth").alias("near_"))
    out = rows.join(nearest, "dir_", "left")
    has, near = F.col("own_").isNotNull(), F.col("near_").isNotNull()
    return out.select(
        *unpacked(files.columns, ("license", "score", "license_source", "license_dir")),
        F.when(has, F.col("own_.license")).when(near, F.col("near_.held.license")).alias("license"),
        F.when(has, F.col("own_.score")).when(near, -F.col("near_.held.s")).alias("score"),
        F.when(has, "own").when(near, "inherited").otherwise("none").alias("license_source"),
        F.when(~has & near, F.col("near_.holder")).alias("license_dir"),
    )
