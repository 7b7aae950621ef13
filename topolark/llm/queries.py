"""Queries of the corpus operators over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolark.llm import ann, chat, decontaminate, licenses, merkle, mixing, pii, quality, simhash, token_alignment, token_files, toxicity, urlfilter
from topolark.llm.common import held_out, table

#: Public byte-level vocabulary of op6_chat.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Public vocabularies of op11_alignment and op13_token_files, and the id that ends a document in the latter.
BYTE_LEVEL, PIECES, WORDS, END_ID = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/word_bpe_49k.json", 2


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: 64 ids share a directory, 64 of those a parent under source and language.

    Every eighth id is the license file of a directory: of the parent for every 512th, else of its own.
    """
    part = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    top = F.concat_ws("/", F.lit(""), part(F.col("source")), part(F.col("lang")), part(F.expr("doc_id div 4096")))
    own = F.concat_ws("/", top, part(F.expr("doc_id div 64")))
    name = part(F.col("doc_id"))
    path = F.when(F.col("doc_id") % 512 == 0, F.concat_ws("/", top, F.concat(F.lit("LICENSE."), name))).when(F.col("doc_id") % 8 == 0, F.concat_ws("/", own, F.concat(F.lit("LICENSE."), name)))
    return docs.withColumn("path", F.coalesce(path, F.concat_ws("/", own, F.concat(name, F.lit(".txt")))))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License of every document, its own or inherited."""
    files = as_files(table(spark, sf_dir, "documents")).select("doc_id", "path", "text")
    return licenses.scan(files).select("doc_id", "path", "license", "score", "license_source", "license_dir")


def op1_sql() -> str:
    idf, unknown = licenses.weights(licenses.TEMPLATES)
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quoted(name)}, {quoted(licenses.plain(text))})" for k, (name, text) in enumerate(licenses.TEMPLATES))
    names = ", ".join(f"({k}, {quoted(name)}, {quoted(licenses.plain(text))})" for k, (name, text) in enumerate(licenses.NAMES))
    name_unknown = licenses.weights(licenses.NAMES)[1]
    tells = f"regexp_matches(part, '{licenses.MENTION}')"
    rest = "said"
    for old, new in licenses.REWRITES:
        rest = f"regexp_replace({rest}, '{old}', '{new}', 'g')"
    return f"""
with files as (
  select row_number() over () as rid, doc_id, replace(lower(text), 'licence', 'license') as text, '/' || coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || coalesce(cast(doc_id // 4096 as varchar), 'unknown')
    || case when doc_id % 512 = 0 then '' else '/' || coalesce(cast(doc_id // 64 as varchar), 'unknown') end as dir,
    case when doc_id % 8 = 0 then '/LICENSE.' || doc_id else '/' || coalesce(cast(doc_id as varchar), 'unknown') || '.txt' end as name from documents),
templates(tid, license, text) as (values {templates}),
template_terms as (
  select tid, license, term, count(*) as n from (select tid, license, unnest(regexp_extract_all(text, '{licenses.TERM}')) as term from templates) group by all),
idf as (
  select term, ln((1 + {len(licenses.TEMPLATES)}.0) / (1 + count(distinct tid))) + 1 as idf from template_terms group by term),
template_norms as (
  select tid, sqrt(sum(pow(n * idf, 2))) as norm from template_terms join idf using (term) group by tid),
names(tid, license, text) as (values {names}),
name_terms as (
  select tid, license, term, count(*) as n from (select tid, license, unnest(regexp_extract_all(text, '{licenses.TERM}')) as term from names) group by all),
name_idf as (
  select term, ln((1 + {len(licenses.NAMES)}.0) / (1 + count(distinct tid))) + 1 as idf from name_terms group by term),
name_norms as (
  select tid, sqrt(sum(pow(n * idf, 2))) as norm from name_terms join name_idf using (term) group by tid),
telling as (
  select rid, text from files where regexp_matches(text, '{licenses.MENTION}')),
lines as (
  select rid, string_split(text, chr(10)) as lines from telling),
parts as (
  select rid, array_to_string(lines[i:i + w - 1], chr(10)) as part from (select rid, lines, unnest(range(1, length(lines) + 1)) as i from lines) cross join (values {', '.join(f'({w + 1})' for w in range(licenses.WINDOW))}) v(w) where i + w - 1 <= length(lines)
  union all select rid, unnest(string_split_regex(text, '{licenses.GAP}')) from telling
),
heads as (
  select rid, regexp_extract(text, '{licenses.COMMENT}') as part from files union all select rid, regexp_extract(text, '{licenses.BLOCK}') from files),
notices as (
  select row_number() over () as lid, rid, part from (select rid, part from parts where {tells} union select rid, part from heads where part <> '' union select rid, text from files where name like '/LICENSE.%' and text is not null)),
line_terms as (
  select rid, lid, term, count(*) as n from (select rid, lid, unnest(regexp_extract_all(part, '{licenses.TERM}')) as term from notices) group by all),
line_norms as (
  select lid, sqrt(sum(pow(n * coalesce(idf, {unknown!r}), 2))) as norm from line_terms left join idf using (term) group by lid),
scores as (
  select l.rid, t.license, round(sum(l.n * t.n * idf * idf) / any_value(ln.norm) / any_value(tn.norm), 6) as score
  from line_terms l join template_terms t using (term) join idf using (term) join line_norms ln using (lid) join template_norms tn using (tid) group by l.rid, l.lid, t.tid, t.license),
said as (
  select row_number() over () as sid, rid, spdx, said from (
    select rid, true as spdx, unnest(regexp_extract_all(text, '{licenses.SPDX}', 1)) as said from telling
    union all select rid, false, unnest(regexp_extract_all(regexp_replace(text, '{licenses.LINE_END}', ' ', 'g'), '{licenses.STATEMENT}')) from telling)),
said_words as (
  select sid, spdx, unnest(words) as word, generate_subscripts(words, 1) as pos from (
    select sid, spdx, case when spdx then regexp_extract_all(said, '{licenses.SPDX_WORD}') else string_split_regex({rest}, '{licenses.SPLIT}') end as words from said)),
said_parts as (
  select row_number() over () as pid, *, case when not spdx then 'i' when word in ('or', 'and') then 'o' when word = 'with' then 'w' when word in ('(', ')') then word else 'i' end as shape
  from said_words where spdx or regexp_matches(word, '[a-z0-9]')),
part_terms as (
  select pid, term, count(*) as n from (select pid, unnest(regexp_extract_all(case when spdx then regexp_replace(word, '[+]$', '-or-later') else word end, '{licenses.TERM}')) as term from said_parts where shape = 'i') group by all),
part_norms as (
  select pid, sqrt(sum(pow(n * coalesce(idf, {name_unknown!r}), 2))) as norm from part_terms left join name_idf using (term) group by pid),
part_scores as (
  select p.pid, t.license, round(sum(p.n * t.n * idf * idf) / any_value(pn.norm) / any_value(tn.norm), 6) as score
  from part_terms p join name_terms t using (term) join name_idf using (term) join part_norms pn using (pid) join name_norms tn using (tid) group by p.pid, t.tid, t.license),
part_names as (
  select pid, license, score from (select *, row_number() over (partition by pid order by score desc, license) as k from part_scores where score >= {licenses.NAME_LEAST}) where k = 1),
read as (
  select sid, spdx, string_agg(shape, '' order by pos) as shape, count(*) filter (shape = 'i' and license is null) as unknown, min(score) as score, count(distinct license) as ids,
    replace(replace(string_agg(coalesce(license, upper(word)), ' ' order by pos), '( ', '('), ' )', ')') as expression, list_sort(list_distinct(list(license) filter (license is not null))) as names
  from said_parts left join part_names using (pid) group by sid, spdx),
statements as (
  select rid, case when spdx or ids > 1 then 0 else 1 end as plain, score, case when spdx then expression
    when regexp_matches(said, '{licenses.CHOICE}') then array_to_string(names, ' OR ') else array_to_string(names, ' AND ') end as license
  from read join said using (sid, spdx) where unknown = 0 and (not spdx or regexp_matches(shape, '{licenses.SHAPE}') and length(replace(shape, '(', '')) = length(replace(shape, ')', '')))),
own as (
  select rid, license, score from (select *, row_number() over (partition by rid order by plain, score desc, license) as k from (
    select rid, 1 as plain, score, license from scores where score >= {licenses.LEAST} union all select rid, plain, score, license from statements)) where k = 1),
holders as (
  select dir, license, score from (select f.dir, o.license, o.score, row_number() over (partition by f.dir order by o.score desc, o.license) as k from files f join own o using (rid) where f.name like '/LICENSE.%') where k = 1),
nearest as (
  select d.dir, arg_max(h.dir, length(h.dir)) as holder from (select distinct dir from files) d join holders h on d.dir = h.dir or starts_with(d.dir, h.dir || '/') group by d.dir)
select f.doc_id, f.dir || f.name as path, coalesce(o.license, h.license) as license, coalesce(o.score, h.score) as score,
  case when o.license is not null then 'own' when h.license is not null then 'inherited' else 'none' end as license_source,
  case when o.license is null then h.dir end as license_dir
from files f left join own o using (rid) left join nearest n on n.dir = f.dir left join holders h on h.dir = n.holder
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    classes = simhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all sources to weights 5, 2, 1, ... takes of each document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), narrow=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that occur in them."""
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, read back from ids and masks."""
    return chat.read_back(chat.format_turns(chat.with_probe(spark, table(spark, sf_dir, "conversations")), VOCABULARY), VOCABULARY)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data found in every document."""
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op8_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"list_sum([case when i % 2 = 0 then ([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])[cast(substr({digits}, -i, 1) as int) + 1] else cast(substr({digits}, -i, 1) as int) end for i in range(1, length({digits}) + 1)]) % 10 = 0"
    compact = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
    mod97 = f"list_reduce([0] || [case when substr({compact}, i, 1) <= '9' then cast(substr({compact}, i, 1) as int) else 1000 + ascii(substr({compact}, i, 1)) - 55 end for i in range(1, length({compact}) + 1)], lambda r, c: case when c >= 1000 then (r * 100 + c - 1000) % 97 else (r * 10 + c) % 97 end) = 1"
    sized = "(m[1:2] || length(replace(m, ' ', ''))) in (" + ", ".join(f"'{x}'" for x in pii.IBAN_LENGTHS.split()) + ")"
    checks = (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
        (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max([case when length(ltrim(p, '0')) > 3 then 999 else cast('0' || ltrim(p, '0') as int) end for p in string_split(m, '.')]) <= 255"),
        (r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) between 12 and 19 and {luhn}"),
        (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) between 9 and 15"),
        (r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", f"{sized} and {mod97}"),
    )
    parts = []
    for rank, (kind, (pattern, valid)) in enumerate(zip(pii.KINDS, checks)):
        says = lambda words: " or ".join(f"contains(near, '{w}')" for w in words) or "false"
        score = f"least(100, {round(kind.score * 100)} + case when {says(kind.near)} then 20 else 0 end - case when {says(kind.far)} then 20 else 0 end)"
        parts.append(f"""select * from (select rid, {rank} as rank, '{kind.name}' as kind, start_at, start_at + length(m) as end_at, {score} as score from (
  select rid, m, translate(right(g, {pii.CONTEXT}) || ' ' || left(after, {pii.CONTEXT}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as near,
    cast(sum(length(g) + length(before)) over (partition by rid order by k) as bigint) as start_at from (
    select rid, k, ms[k] as m, gs[k] as g, gs[k + 1] as after, case when k > 1 then ms[k - 1] else '' end as before from (
      select rid, ms, gs, unnest(range(1, length(ms) + 1)) as k from (
        select rid, regexp_extract_all(t, '{pattern}') as ms, string_split_regex(t, '{pattern}') as gs from docs)))) where {valid}) where score >= {round(kind.least * 100)}""")
    text = "coalesce(string_agg(kind || ':' || start_at || ':' || end_at, ',' order by start_at, rank) filter (where rank < {}), '')"
    count = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in pii.BASE)
    return f"""with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
found as ({' union all '.join(parts)})
select d.doc_id, {count}, sha256({text.format(4)}) as base_sha256,
  {text.format(5)} as spans, count(kind) as n_spans, coalesce(string_agg(cast(score as varchar), ',' order by start_at, rank), '') as scores from docs d left join found f on f.rid = d.rid group by d.rid, d.doc_id"""


def op6_sql() -> str:
    marked = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in chat.CONTROL)
    longer = lambda c: f"length({c}) + length(regexp_extract_all({c}, '{marked}'))"
    ends = len(chat.START) + len(chat.MIDDLE) + len(chat.END)
    return f"""with every as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
joined as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, text) as turns,
  coalesce(string_agg(text, '' order by turn nulls last, role, text) filter (where role = 'assistant'), '') as loss, cast(sum({ends} + {longer('role')} + {longer('text')}) as bigint) as formatted_chars
  from every group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars from joined"""


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


OP9_SQL = """
with rest as (
  select page_id, case when url is null or strpos(url, '://') = 0 then '' else substr(url, strpos(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from rest),
cut as (
  select page_id, lower(raw) as host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from parts),
rules(rule_host, rule_path, rule_verdict) as (
  values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best as (
  select page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule, arg_max(rule_verdict, length(rule_host || rule_path)) as rule_verdict
  from cut join rules on (host = rule_host or suffix(host, '.' || rule_host)) and prefix(path, rule_path) group by page_id),
domains as (
  select n || '.example.' || t as domain
  from (values ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(n), (values ('com'), ('net'), ('org')) b(t)),
listed as (
  select distinct page_id from cut join domains on host = domain or suffix(host, '.' || domain))
select cut.page_id, host, path, best.rule, listed.page_id is not null as listed,
  coalesce(rule_verdict, case when listed.page_id is not null then 'block' else 'allow' end) as verdict
from cut left join best on cut.page_id = best.page_id left join listed on cut.page_id = listed.page_id
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and median grade and tail probabilities of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, quality.grades_of(table(spark, sf_dir, "labels")), 3)
    tail = F.col("tail")
    rated = quality.rate(docs, model, 3, ["doc_id"])
    return rated.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.expected_grade(tail).alias("expected_grade"), tail[0].alias("p_at_least_1"), tail[1].alias("p_at_least_2"), F.when(tail[0] < 0.5, 0).when(tail[1] < 0.5, 1).otherwise(2).alias("grade"), (tail[0] >= 0.5).alias("keep"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizers aligned over every document."""
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), BYTE_LEVEL, PIECES)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, held against texts some of which are lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proved = merkle.manifest(table(spark, sf_dir, "documents"), F.when(tampered, lowered).otherwise(F.col("text")))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_sql() -> str:
    said = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    fields = [f"cast({c} as varchar)" for c in merkle.FIELDS]
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(said(f) for f in [*fields[:-1], text]) + ")"
    # CRC-32 bit by bit: a code from 1000 on takes in a byte, a zero shifts.
    steps = "flatten([[1000 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0] for c in string_split(cast(doc_id as varchar), '')])"
    crc = f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda r, x: case when x >= 1000 then xor(r, x - 1000) when r % 2 = 1 then xor(r // 2, 3988292384) else r // 2 end), 4294967295)"
    parts = [
        f"leaves as (select row_number() over () as rid, doc_id, coalesce('s' || lang, 'n') as tree, {leaf('text')} as leaf, case when doc_id is not null and {crc} % 3 = 0 then {leaf(lowered)} else {leaf('text')} end as claim from documents)",
        "ranked as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx from leaves)",
    ]

    def climb(name: str, start: str, rounds: int) -> None:
        """Levels name0, name1, ... with the siblings before and after each node, and name_top."""
        parts.append(f"{name}_n0 as ({start})")
        for k in range(rounds):
            run = "over (partition by tree, idx // 8 order by idx rows between"
            parts.append(f"{name}{k} as (select *, count(*) over (partition by tree) as many, coalesce(string_agg(d, '') {run} unbounded preceding and 1 preceding), '') as before, coalesce(string_agg(d, '') {run} 1 following and unbounded following), '') as after from {name}_n{k})")
            parts.append(f"{name}_n{k + 1} as (select tree, idx // 8 as idx, case when any_value(many) = 1 then any_value(d) else sha256(string_agg(d, '' order by idx)) end as d from {name}{k} group by tree, idx // 8)")
        parts.append(f"{name}_top as (select tree, d from {name}_n{rounds})")

    climb("low", "select tree, idx, leaf as d from ranked", 7)
    climb("high", "select '' as tree, row_number() over (order by tree) - 1 as idx, d from low_top", 3)
    parts.append("placed as (select tree, row_number() over (order by tree) - 1 as idx from low_top)")
    joins, fold, proof = [], "r.claim", []
    for name, of, rounds in (("low", "r", 7), ("high", "p", 3)):
        for k in range(rounds):
            at = f"{name}{k}"
            joins.append(f"join {at} on {at}.idx = {of}.idx // {8**k}" + (f" and {at}.tree = r.tree" if name == "low" else ""))
            fold = f"case when {at}.many > 1 then sha256({at}.before || {fold} || {at}.after) else {fold} end"
            proof.append(f"case when {at}.many > 1 then {at}.before || {at}.after else '' end")
            parts_of = f"f{len(joins)}"
            joins.append(f"cross join lateral (select {fold} as d) {parts_of}")
            fold = f"{parts_of}.d"
    return f"""with {", ".join(parts)}
select r.doc_id, r.leaf, s.d as subroot, t.d as root, sha256({" || ".join(proof)}) as proof_sha256, {fold} as folded_root, {fold} = t.d as verified
from ranked r join placed p on p.tree = r.tree {" ".join(joins)} join low_top s on s.tree = r.tree cross join high_top t"""


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to files and read back."""
    manifest, folder = token_files.write_ids(table(spark, sf_dir, "documents"), WORDS, END_ID)
    return token_files.read_ids(manifest, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_licenses": op1_licenses, "op2_simhash": op2_simhash, "op3_mixing": op3_mixing, "op4_toxicity": op4_toxicity, "op5_decontamination": op5_decontamination, "op6_chat": op6_chat, "op7_ann": op7_ann, "op8_pii": op8_pii, "op9_urlfilter": op9_urlfilter, "op10_quality": op10_quality, "op11_alignment": op11_alignment, "op12_merkle": op12_merkle, "op13_token_files": op13_token_files}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": op1_sql(), "op6_chat": op6_sql(), "op8_pii": op8_sql(), "op9_urlfilter": OP9_SQL, "op12_merkle": op12_sql()}
