"""The queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, embedding_dedup, html, language, merkle, mixing, packing, pii, quality, secrets, simhash, spelling, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).drop("n_template")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verifies a copy in which the text of every fifth document, by the CRC-32 of its id, has lost its capitals."""
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    altered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.leaf("doc_id", "source", "lang", "n_chars", lower))
    return merkle.manifest(table(spark, sf_dir, "documents"), altered=altered).drop("source", "place")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_embedding_near_dedup, op3_pii, op4_importance_resampling, op5_toxicity, op6_secret_scans, op7_best_fit_packing, op8_html_extraction, op9_mix_sources, op10_nearest_neighbours, op11_spelling_variants, op12_merkle_manifest, op13_language_id)}

#: CRC-32 of a list of bytes in DuckDB, given a row tab with the 256 steps of its table.
CRC_TABLE = "tab as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as steps)"
CRC = "xor(list_reduce({}, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295)"



def _leaf(text: str) -> str:
    parts = (f"coalesce(octet_length(encode({x}))::varchar || ':' || {x}, '-')" for x in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))
    return f"sha256({' || '.join(parts)})"


#: DuckDB SQL of the operators that it can express. Op 2's pairs are exact; its hashing finds them with a chance of 0.9995 each at least.
ORACLE: dict[str, str] = {
    "op2_embedding_near_dedup": """with recursive pairs as (select a.vec_id as a, b.vec_id as b from embeddings a, embeddings b
where a.vec_id <> b.vec_id and list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.95),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from reach r join pairs p on p.a = r.b),
component as (select a as vec_id, min(b) as component_id from reach group by a),
links as (select a as vec_id, count(*) as n from pairs group by a)
select vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from component left join links using (vec_id)""",
    "op9_mix_sources": """with sized as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, coalesce(length(text), 0) as chars from documents),
keyed as (select *, -ln((('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
/ greatest(0.25, least(1.0, chars / greatest(size, 1) / 4.0, 8.0 / greatest(chars / greatest(size, 1), 0.1))) as key from sized),
sources as (select source, sum(size)::double as s, row_number() over (order by source nulls last) - 1 as nth from keyed group by source),
caps as (select *, [3.0, 1.0, 2.0][nth % 3 + 1]::double as w, 2 * s as cap, 2 * s / [3.0, 1.0, 2.0][nth % 3 + 1]::double as full_at from sources),
levels as (select *, ((select sum(s) from sources) * 1.5 - coalesce(sum(cap) over (order by full_at, nth rows between unbounded preceding and 1 preceding), 0))
/ sum(w) over (order by full_at, nth rows between current row and unbounded following) as level from caps),
fit as (select min_by(level, (full_at, nth)) as level from levels where level <= full_at),
goals as (select source, s, case when f.level is null then cap else least(cap, f.level * w) end as target from levels, fit f),
ends as (select *, coalesce(floor(target / nullif(s, 0)), 0) as epochs from goals),
summed as (select k.*, s, target, epochs, target - epochs * s as rest,
coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from keyed k join ends e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, s::bigint as source_size, round(target, 6) as target, (size * (epochs + (before + size / 2.0 <= rest)::int))::bigint as taken from summed""",
    # The tables' pages all mark their article, which holds h1 and p, b and br, and no chrome; the rule for other pages is held by tests.
    "op8_html_extraction": r"""with cut as (select page_id, url, string_split_regex(replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<br>', ' '), '</?(?:h1|p)>') as parts from pages),
plain as (select page_id, url, list_filter(list_transform(parts, lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> '') as blocks from cut)
select page_id, url, coalesce(array_to_string(blocks, chr(10)), '') as text, length(coalesce(array_to_string(blocks, chr(10)), '')) as n_chars from plain""",
    # Near words by what deleting one code point leaves: the same text at the same place (replaced), or a word (deleted).
    "op11_spelling_variants": f"""with recursive {CRC_TABLE},
runs as (select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents),
counted as (select id, run, count(*) as n from runs group by all),
bytes as (select run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when ord(c) < 128 then [ord(c)] else [192 | (ord(c) >> 6), 128 | (ord(c) & 63)] end)) as b from counted),
hashed as (select run, n, {CRC.format("b")} as h from bytes, tab),
words as (select case when h % 97 = 0 then run[: (h % length(run))::int] || run[(h % length(run))::int + 2 :] else run end as word, sum(n) as n from hashed group by 1),
kept as (select word, n from words where length(word) >= 5 and n >= 3),
cut as (select word, n, unnest(range(1, length(word) + 1)) as pos from kept),
left_ as (select word, n, pos, word[: pos - 1] || word[pos + 1 :] as rest from cut),
pairs as (select a.word as a, b.word as b from left_ a join left_ b on a.rest = b.rest and a.pos = b.pos and a.word <> b.word
union select l.word, k.word from left_ l join kept k on l.rest = k.word union select k.word, l.word from left_ l join kept k on l.rest = k.word),
near as (select p.a as word, count(*) as n_near, max(k.n) as most from pairs p join kept k on k.word = p.b group by 1),
forms as (select n.word, k.n, n.n_near, n.most, min(k2.word) as form from near n join kept k on k.word = n.word join pairs p on p.a = n.word join kept k2 on k2.word = p.b and k2.n = n.most group by all),
chosen as (select word, n_near, case when most >= 2 * n then form end as form, case when most >= 2 * n then most end as form_n from forms),
chain as (select word, word as top from kept union all select c.word, f.form from chain c join chosen f on f.word = c.top where f.form is not null),
ends as (select c.word, c.top as root from chain c left join chosen f on f.word = c.top where f.form is null)
select word, n::bigint as n, coalesce(n_near, 0)::bigint as n_near, form, form_n::bigint as form_n, root from kept left join chosen using (word) left join ends using (word)""",
    "op12_merkle_manifest": f"""with recursive {CRC_TABLE},
rows_ as (select *, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)) as b from documents),
leaves as (select doc_id, source, {_leaf("text")} as leaf, case when {CRC.format("b")} % 5 = 0 then {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} end as altered from rows_, tab),
placed as (select *, row_number() over () as k, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from leaves),
nodes as (select source, 0 as level, pos, n, leaf as d from placed
union all select source, level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' order by pos)) from nodes where n > 1 group by source, level, pos // 16, n),
tops as (select source, d as subroot, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
upper_ as (select 0 as level, pos, n, subroot as d from tops
union all select level + 1, pos // 16, (n + 15) // 16, sha256(string_agg(d, '' order by pos)) from upper_ where n > 1 group by level, pos // 16, n),
sides as (select *, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as r
from nodes where n > 1 window run as (partition by source, level, pos // 16 order by pos)),
upper_sides as (select *, coalesce(string_agg(d, '') over (run rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(d, '') over (run rows between 1 following and unbounded following), '') as r
from upper_ where n > 1 window run as (partition by level, pos // 16 order by pos)),
fold as (select k, source, 0 as level, pos, n, coalesce(altered, leaf) as x, '' as proof from placed
union all select k, f.source, f.level + 1, f.pos // 16, (f.n + 15) // 16, sha256(l || x || r), proof || l || r from fold f join sides s on f.source is not distinct from s.source and f.level = s.level and f.pos = s.pos where f.n > 1),
above as (select k, 0 as level, t.pos, t.n, x, proof from fold f join tops t on f.source is not distinct from t.source where f.n = 1
union all select k, f.level + 1, f.pos // 16, (f.n + 15) // 16, sha256(l || x || r), proof || l || r from above f join upper_sides s on f.level = s.level and f.pos = s.pos where f.n > 1)
select doc_id, leaf, subroot, u.d as root, sha256(proof) as proof_sha256, x as folded_root, x = u.d as verified
from placed p join above a on a.k = p.k and a.n = 1 join tops t on t.source is not distinct from p.source join upper_ u on u.n = 1""",
}
