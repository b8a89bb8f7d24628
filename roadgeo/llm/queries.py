"""The corpus operators as named queries over whole tables, and DuckDB statements for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadgeo.llm import bpe, language, merkle, mixing, quality, rules, secret_scan, shingle_join, site_tree, substring_dedup, topk, toxicity, whitening
from roadgeo.llm.common import table

#: Rank file of the encoding queries, by path.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_site_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op2_block_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.link(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the same ledger as op9_rule_ledger."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op11_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose crc32 is even lose the line ends of their text."""
    tampers = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampers, F.replace("text", F.lit("\n"), F.lit("")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_site_tree": op1_site_tree,
    "op2_block_top_k": op2_block_top_k,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_shingle_join": op6_shingle_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_poisson_mix": op8_poisson_mix,
    "op9_rule_ledger": op9_rule_ledger,
    "rule_ablations": rule_ablations,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_filters": op11_language_filters,
    "op12_whitening": op12_whitening,
    "op13_merkle_manifest": op13_merkle_manifest,
}


def _mix_sql() -> str:
    step, entries, seed = mixing.STEP, mixing.ENTRIES, mixing.SEED
    uniform = lambda text: f"(('0x' || substr(md5({text}), 1, 13))::bigint / {1 << 52}.0::double)"
    doc = "coalesce(doc_id::varchar, 'null')"
    return f"""
with counts as (select source, count(*) as n from documents group by source),
rates as (
    select source, pow(n, {mixing.TEMPERATURE}) * (select sum(n) from counts) / (select sum(pow(n, {mixing.TEMPERATURE})) from counts) / n as rate
    from counts),
parts as (select source, rate, greatest(1, ceil(rate / {step}))::int as parts from rates),
terms as (
    select source, parts, k, exp(-rate / parts) * pow(rate / parts, k) / gamma(k + 1) as p
    from parts, range(0, {entries} + 1) t(k)),
cdfs as (select source, parts, k, sum(p) over (partition by source order by k) as c from terms),
dist as (select source, any_value(parts) as parts, list(c order by k) as cdf from cdfs group by source),
draws as (
    select d.*, list_sum(list_transform(range(1, parts + 1), lambda j:
        len(list_filter(cdf, lambda c: c <= {uniform(f"'{seed}|' || {doc} || '|' || j::varchar")})))) as times
    from documents d join dist on d.source is not distinct from dist.source),
copies as (select * exclude (times), unnest(range(1, times::bigint + 1))::int as copy from draws where times > 0)
select *, {uniform(f"'{seed}-order|' || {doc} || '|' || copy::varchar")} as shuffle_key from copies"""


def _ledger_tables() -> str:
    """The ledger as table f of a WITH clause."""
    white = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    bits = " + ".join(f"case when {f} then {1 << i} else 0 end" for i, f in enumerate(rules.RULES.values()))
    count = lambda chars: f"length(text) - length(regexp_replace(text, '{chars}', '', 'g'))"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{word}+') as words,
      list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '{word}')) as lines from d),
windows as (
    select r, i, array_to_string(words[i:i + {rules.WINDOW - 1}], ' ') as win
    from (select r, words, unnest(range(1, len(words) - {rules.WINDOW - 2})) as i from w)),
counted as (select r, i, count(*) over (partition by r, win) as n from windows),
gaps as (select r, least({rules.WINDOW}, coalesce(lead(i) over (partition by r order by i) - i, {rules.WINDOW})) as gap from counted where n > 1),
covered as (select r, sum(gap) as n from gaps group by r),
m as (
    select doc_id, len(words)::bigint as n_words, length(regexp_replace(text, '{white}+', '', 'g'))::bigint as word_chars,
        ({count('[#*$%&|<>]+')})::bigint as n_symbols, len(lines)::bigint as n_lines,
        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
        ({count(chr(92) + 'p{Lu}+')})::bigint as n_upper, ({count('!+')})::bigint as n_exclaim
    from w left join covered using (r)),
f as (select *, ({bits})::bigint as failed from m)"""


def _ledger_sql() -> str:
    bad = lambda r: f"failed & {rules.mask(r)} <> 0"
    return f"""{_ledger_tables()}
select *, {bad(rules.BASE)} as base_failed, not ({bad(rules.BASE)}) and not ({bad(rules.POLICIES[rules.CURRENT])}) as kept, '{rules.CURRENT}' as policy from f"""


def _ablations_sql() -> str:
    arms = ", ".join(f"('{v}', '{r}', {rules.mask(of)}, {rules.mask([r])})" for v, of in rules.POLICIES.items() for r in of)
    return f"""{_ledger_tables()}
select policy, rule, count(*) filter (where failed & bit <> 0) as n_failed, count(*) filter (where failed & mask = bit) as n_failed_alone
from f, (values {arms}) arms(policy, rule, mask, bit) group by policy, rule"""


def _top_k_sql() -> str:
    return f"""
with v as (
    select row_number() over () as r, vec_id, [floor({topk.SCALE} * x::double)::bigint for x in embedding] as parts
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
    select q.r, q.vec_id as query_id, c.vec_id,
        list_sum(list_transform(list_zip(q.parts, c.parts), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0)))::bigint as score
    from v q join v c on q.vec_id % {topk.EVERY} = 0 and c.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id, r order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= {topk.K}"""


def _manifest_sql() -> str:
    field = lambda e: f"coalesce(strlen(({e})::varchar)::varchar || ':' || ({e})::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in merkle.FIELDS) + ")"
    f = merkle.FANOUT
    crc = """xor(4294967295, list_reduce(
        [4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint),
        lambda a, b: list_reduce([xor(a, b)] || [0::bigint for _ in range(8)], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
    up = lambda name, grp: f"""
    select {grp} as grp, lvl + 1, pos // {f}, (n + {f - 1}) // {f}, sha256(string_agg(digest, '' order by pos))
    from {name} where n > 1 group by grp, lvl, pos // {f}, n"""  # noqa: E731
    fold = lambda name, nodes: f"""
    select t.r, t.grp, t.lvl + 1, t.pos // {f}, (t.n + {f - 1}) // {f},
        sha256(string_agg(case when o.pos = t.pos then t.digest else o.digest end, '' order by o.pos)),
        t.proof || coalesce(string_agg(o.digest, '' order by o.pos) filter (where o.pos <> t.pos), '')
    from {name} t join {nodes} o on o.grp is not distinct from t.grp and o.lvl = t.lvl and o.pos // {f} = t.pos // {f}
    where t.n > 1 group by t.r, t.grp, t.lvl, t.pos, t.n, t.digest, t.proof"""  # noqa: E731
    return f"""
with recursive hashed as (
    select row_number() over () as r, doc_id, source, {leaf("text")} as leaf,
        case when doc_id is not null and {crc} % 2 = 0 then {leaf("replace(text, chr(10), '')")} else {leaf("text")} end as other
    from documents),
leaves as (
    select *, row_number() over (partition by source order by doc_id nulls first, leaf, r) - 1 as pos, count(*) over (partition by source) as n
    from hashed),
nodes(grp, lvl, pos, n, digest) as (
    select source, 0, pos, n, leaf from leaves
    union all {up("nodes", "grp")}),
subroots as (select grp as source, digest, row_number() over (order by grp nulls first) - 1 as place, count(*) over () as n from nodes where n = 1),
tops(grp, lvl, pos, n, digest) as (
    select 0, 0, place, n, digest from subroots
    union all {up("tops", "grp")}),
low(r, grp, lvl, pos, n, digest, proof) as (
    select r, source, 0, pos, n, other, '' from leaves
    union all {fold("low", "nodes")}),
high(r, grp, lvl, pos, n, digest, proof) as (
    select l.r, 0, 0, s.place, s.n, l.digest, l.proof from low l join subroots s on l.grp is not distinct from s.source where l.n = 1
    union all {fold("high", "tops")})
select d.doc_id, d.source, d.leaf, s.digest as subroot, t.digest as root, sha256(h.proof) as proof_sha256,
    h.digest as folded_root, h.digest = t.digest as verified
from hashed d join subroots s on d.source is not distinct from s.source join high h on h.r = d.r and h.n = 1 join tops t on t.n = 1"""


ORACLE: dict[str, str] = {
    "op2_block_top_k": _top_k_sql(),
    "op8_poisson_mix": _mix_sql(),
    "op9_rule_ledger": _ledger_sql(),
    "rule_ablations": _ablations_sql(),
    "op13_merkle_manifest": _manifest_sql(),
}
