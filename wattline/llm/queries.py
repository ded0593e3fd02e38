"""The registered queries of this subpackage, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm.ann import search_multi_index
from wattline.llm.centroids import cluster_by_centroids
from wattline.llm.exactknn import exact_top_k
from wattline.llm.fingerprints import fingerprint_edits
from wattline.llm.langid import identify_language
from wattline.llm.linededup import remove_repeated_lines
from wattline.llm.mixing import schedule_mix
from wattline.llm.neardup import near_duplicate_classes
from wattline.llm.packing import pack_by_powers_of_two
from wattline.llm.resampling import resample_by_importance
from wattline.llm.runtime import documents
from wattline.llm.sharding import shard_by_sampled_splitters
from wattline.llm.substring import dedup_substrings
from wattline.llm.toxicity import score_toxicity


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_multi_index(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op3_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its block, the block's window and slot, and the document's place in the mixture."""
    return schedule_mix(documents(spark, sf_dir)).drop("doc")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir))


def op5_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_sampled_splitters(documents(spark, sf_dir), shards=40)


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_powers_of_two(documents(spark, sf_dir))


def op7_content_defined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: what was cut out as a repeated passage, and the digest of the text that stays."""
    out = dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "chunks", "repeated_bytes", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"), F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op8_pivot_distance_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the lines removed, by number, and the digest of the text that stays."""
    out = remove_repeated_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.size("removed").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"), F.length("text").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op10_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its class, named by the smallest id in it, and whether it is the one that stays."""
    out = near_duplicate_classes(documents(spark, sf_dir))
    return out.select(F.col("doc").alias("doc_id"), "class_id", (F.col("doc") == F.col("class_id")).alias("stays"), "n_shingles")


def op11_piecewise_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint, that of the edited text, and how like they and the next document's are."""
    return fingerprint_edits(documents(spark, sf_dir))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its weight towards the benchmark's n-grams, its score, and its rank in the draw."""
    return resample_by_importance(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_partial_distance_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_by_centroids(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_noisy_channel_toxicity": op1_noisy_channel_toxicity,
    "op2_inverted_multi_index": op2_inverted_multi_index,
    "op3_pfair_mix": op3_pfair_mix,
    "op4_language_id": op4_language_id,
    "op5_sampled_splitters": op5_sampled_splitters,
    "op6_power_of_two_packing": op6_power_of_two_packing,
    "op7_content_defined_chunks": op7_content_defined_chunks,
    "op8_pivot_distance_top_k": op8_pivot_distance_top_k,
    "op9_line_dedup": op9_line_dedup,
    "op10_dart_minhash": op10_dart_minhash,
    "op11_piecewise_hashing": op11_piecewise_hashing,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_partial_distance_clusters": op13_partial_distance_clusters,
}

#: The words of a text in SQL: runs of ASCII letters and digits and of any other characters beyond ASCII.
_WORDS = "regexp_extract_all(lower({}), '(?:[a-z0-9]|[^\\x00-\\x7F])+')"


def _crc_step(n: int) -> int:
    for _ in range(4):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


#: crc32 of ``gram``, four bits at a time.
_CRC = f"""xor(list_reduce(list_transform(range(cast(length(hex(encode(gram))) as bigint)), lambda i: instr('0123456789ABCDEF', substr(hex(encode(gram)), xor(i, 1) + 1, 1)) - 1),
        lambda c, x: xor(c >> 4, {[_crc_step(n) for n in range(16)]}[(xor(c, x) & 15) + 1]), 4294967295), 4294967295)"""


def _resampling_sql() -> str:
    grams = lambda table, key: f"""select {key} as id, unnest(flatten([w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])])) as gram
        from (select {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table})"""  # noqa: E731
    return f"""
    with ours as materialized ({grams("documents", "doc_id")}), theirs as materialized ({grams("benchmark", "item_id")}),
    hashed as materialized (select gram, {_CRC} % 10000 as bucket from (select gram from ours union select gram from theirs)),
    s as (select bucket, count(*) as n from ours join hashed using (gram) group by bucket), t as (select bucket, count(*) as n from theirs join hashed using (gram) group by bucket),
    gains as (select x.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select sum(n) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select sum(n) from t) + 10000)::double))) as bigint) as gain
        from (select unnest(range(10000)) as bucket) x left join s on s.bucket = x.bucket left join t on t.bucket = x.bucket),
    weights as (select id, count(*) as n_features, cast(sum(gain) as bigint) as weight from ours join hashed using (gram) join gains using (bucket) group by id),
    scored as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('42:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score
        from documents left join weights on id = doc_id),
    ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place from scored where n_features >= 57)
    select doc_id, n_features, weight, score, case when place <= 5 * (select count(*) from ranked) // 100 then place end as "rank" from scored left join ranked using (doc_id)"""


def _clusters_sql(rounds: int = 10) -> str:
    steps = [
        """v as materialized (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        """c0 as materialized (select cast(row_number() over (order by sha256('3:' || vec_id)) - 1 as integer) as j, e as c from v order by sha256('3:' || vec_id) limit 8)""",
    ]
    near = "select vec_id, e, j, list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from v cross join c{n} qualify row_number() over (partition by vec_id order by d, j) = 1"
    for n in range(rounds):
        steps.append(f"a{n} as materialized ({near.format(n=n)})")
        steps.append(f"""m{n} as (select j, list(floor_mean order by pos) as c from (select j, pos, (sum(x)::bigint - ((sum(x)::bigint % count(*)) + count(*)) % count(*)) // count(*) as floor_mean from (select j, unnest(e) as x, generate_subscripts(e, 1) as pos from a{n}) group by j, pos) group by j)""")
        steps.append(f"c{n + 1} as materialized (select j, coalesce(m{n}.c::double[], c{n}.c) as c from c{n} left join m{n} using (j))")
    steps.append(f"last as materialized ({near.format(n=rounds)})")
    return "with " + ",\n    ".join(steps) + f"""
    select vec_id, j as cluster, d::bigint as distance, (sum(d) over (partition by j))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(list_transform(c, lambda x: x::bigint::varchar), ',')) as centroid_sha256
    from last join c{rounds} using (j)"""


ORACLES: dict[str, str] = {
    "op12_importance_resampling": _resampling_sql(),
    "op13_partial_distance_clusters": _clusters_sql(),
    "op9_line_dedup": f"""
    with lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as k from documents where text is not null),
    worded as (select doc_id, k, line, list_sort(list_distinct({_WORDS.format('line')})) as words from lines),
    sets as (select words, len(words) as n, min(row(doc_id, k)) as first, row_number() over () as id from worded where len(words) > 0 group by words),
    tokens as (select id, n, first, unnest(words) as word from sets),
    ranked as (select *, row_number() over (partition by id order by df, word) as pos from (select *, count(*) over (partition by word) as df from tokens)),
    prefix as (select * from ranked where pos <= n - (4 * n + 4) // 5 + 1),
    pairs as (select distinct a.id as later, b.id as earlier from prefix a join prefix b on a.word = b.word and a.first > b.first and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    met as (select x.id, x.n + y.n as total, len(list_intersect(x.words, y.words)) as common from pairs join sets x on x.id = later join sets y on y.id = earlier),
    near as (select distinct id from met where 5 * common >= 4 * (total - common)),
    judged as (select w.doc_id, w.k, w.line, s.id is not null and (row(w.doc_id, w.k) <> s.first or s.id in (select id from near)) as gone from worded w left join sets s on s.words = w.words and len(w.words) > 0),
    texts as (select doc_id, count(*) filter (where gone) as n_removed, coalesce(string_agg(cast(k as varchar), ',' order by k) filter (where gone), '') as removed_lines, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as kept from judged group by doc_id)
    select d.doc_id, cast(coalesce(n_removed, 0) as integer) as n_removed, coalesce(removed_lines, '') as removed_lines, cast(length(kept) as integer) as kept_chars, md5(kept) as kept_md5 from documents d left join texts t on t.doc_id = d.doc_id""",
    "op10_dart_minhash": f"""
    with recursive worded as (select doc_id, {_WORDS.format("coalesce(text, '')")} as words from documents),
    shingled as (select doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle from worded),
    numbered as (select doc_id, shingle, row_number() over (partition by doc_id, shingle) as nth from shingled),
    sizes as (select doc_id, count(*) as n from numbered group by doc_id),
    common as (select a.doc_id as a, b.doc_id as b, count(*) as m from numbered a join numbered b on a.shingle = b.shingle and a.nth = b.nth and a.doc_id < b.doc_id group by all),
    links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 5 * m >= 4 * (x.n + y.n - m)),
    both_ways as (select a as v, b as w from links union all select b, a from links),
    reach as (select doc_id as v, doc_id as c from documents union select e.w, r.c from reach r join both_ways e on e.v = r.v where r.c < e.w),
    classes as (select v, min(c) as class_id from reach group by v)
    select doc_id, class_id, doc_id = class_id as stays, coalesce(n, 0) as n_shingles from classes left join sizes on doc_id = v""",
    "op8_pivot_distance_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as e from embeddings where embedding is not null),
        scored as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
        ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as "rank" from scored)
        select query_id, "rank", vec_id, score from ranked where "rank" <= 5""",
}
