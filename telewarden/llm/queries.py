"""Registered queries of the text operators, over whole tables, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telewarden.llm import collocations, curve_packing, embedding_dedup, language_id, minhash_dedup, mixing, packing, sampling, sharding, spelling, token_counts, token_files, topk_search, toxicity
from telewarden.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
#: Tokens a training sequence holds.
SEQUENCE_TOKENS = 2048
#: And one that is filled along the curve.
CURVE_TOKENS = 1024
#: Ends each document in the token files.
DOCUMENT_END_ID = 2
#: Ends each document in the training sequences.
PACKED_END_ID = 0
#: Rows with this remainder of CRC-32 of the id are held out when languages are learned.
LANGUAGE_FOLDS, HELD_LANGUAGE_FOLD = 4, 2
#: The same for toxicity.
TOXICITY_FOLDS, HELD_TOXICITY_FOLD = 5, 0
#: One in so many (document, run) pairs loses a letter before spelling variants are sought.
DAMAGED_SHARE = 97


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, and whether they exceed a training sequence."""
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(WORD_VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > SEQUENCE_TOKENS)


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids as read back from the token files."""
    location = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), location, public_tokenizers.path(WORD_VOCABULARY), DOCUMENT_END_ID)
    return token_files.read_digests(spark, location)


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and where each lies in the training sequences."""
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_VOCABULARY), PACKED_END_ID, SEQUENCE_TOKENS)


@query("op7_source_mixing")
def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that the mix takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_sharding")
def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Slot and shard of every document."""
    names = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]
    return sharding.place(table(spark, folder, "documents"), names)


@query(
    "op2_block_topk",
    """with v as (select vec_id, [cast(floor(64 * cast(x as double)) as double) for x in embedding] as q from embeddings
            where embedding is not null and len([1 for x in embedding if x is null or not isfinite(x)]) = 0),
        s as (select a.vec_id as query_id, b.vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
            from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) where a.vec_id % 20 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
)
def op2_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest-scoring rows for every query row."""
    return topk_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@query(
    "op5_embedding_dedup",
    """with recursive v as (select vec_id, [cast(x as double) for x in embedding] as q from embeddings where embedding is not null
            and len([1 for x in embedding if x is null or not isfinite(x)]) = 0 and len([1 for x in embedding if x <> 0]) > 0),
        e as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q) and list_cosine_similarity(a.q, b.q) >= 0.9),
        r as (select vec_id as a, vec_id as b from embeddings union select r.a, e.b from r join e on r.b = e.a),
        c as (select a as vec_id, min(b) as component_id from r group by a),
        n as (select a as vec_id, count(*) as n_links from e group by a)
        select c.vec_id, coalesce(n_links, 0) as n_links, component_id, c.vec_id = component_id as kept from c left join n on n.vec_id = c.vec_id""",
)
def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and fate of every vector."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), 0.9)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document; a fold by CRC-32 of the id is never learned from."""
    docs = table(spark, folder, "documents")
    fold = sampling.fold("doc_id", LANGUAGE_FOLDS)
    model = language_id.fit(docs, fold != HELD_LANGUAGE_FOLD)
    return language_id.identify(docs, model).select("doc_id", (fold == HELD_LANGUAGE_FOLD).alias("held_out"), "lang_pred", "score")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; a fold by CRC-32 of the id is never learned from."""
    docs = table(spark, folder, "documents")
    fold = sampling.fold("doc_id", TOXICITY_FOLDS)
    model = toxicity.fit(docs, table(spark, folder, "labels"), fold != HELD_TOXICITY_FOLD)
    return toxicity.score(docs, model).select("doc_id", (fold == HELD_TOXICITY_FOLD).alias("held_out"), "score", "predicted")


@query("op9_minhash_dedup")
def op9_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of every document, and whether it stays."""
    return minhash_dedup.near_duplicates(table(spark, folder, "documents")).drop("key")


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text of code points up to 255, half a byte at a time."""
    steps = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        steps.append(str(c))
    byte = "case when u < 128 then [u & 15, u >> 4] else [(192 + (u >> 6)) & 15, (192 + (u >> 6)) >> 4, (128 + (u & 63)) & 15, (128 + (u & 63)) >> 4] end"
    halves = f"flatten([{byte} for u in [unicode(c)::bigint for c in string_split({text}, '')]])"
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, {halves}),
        lambda c, h: xor(c >> 4, [{", ".join(steps)}][(xor(c, h) & 15) + 1]::bigint)), 4294967295::bigint)"""


@query(
    "op11_spelling_variants",
    f"""with recursive runs as (select cast(doc_id as varchar) as id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents),
        low as (select id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') as run from runs),
        once as (select id, run, count(*) as c from low group by id, run),
        hashed as (select *, {_crc32_sql("concat(id, ':', run)")} as h from once),
        damaged as (select c, case when h % {DAMAGED_SHARE} <> 0 then run
            else concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) end as word from hashed),
        words as (select word, cast(sum(c) as bigint) as n from damaged where length(word) >= 5 group by word having sum(c) >= 3),
        holes as (select word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) as rest
            from (select word, unnest(range(1, length(word) + 1)) as i from words) p),
        near as (select a.word, b.word as other from holes a join holes b on a.i = b.i and a.rest = b.rest and a.word <> b.word
            union select h.word, w.word from holes h join words w on h.rest = w.word
            union select w.word, h.word from holes h join words w on h.rest = w.word),
        best as (select near.word, count(*) as n_near, first(struct_pack(form := o.word, n := o.n) order by o.n desc, o.word) as b
            from near join words o on near.other = o.word group by near.word),
        formed as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when b.n >= 2 * words.n then b.form end as form,
            case when b.n >= 2 * words.n then b.n end as form_n from words left join best on words.word = best.word),
        steps as (select word, word as here, 0 as depth from formed
            union all select s.word, f.form, depth + 1 from steps s join formed f on s.here = f.word where f.form is not null)
        select f.word, n, n_near, form, form_n, root from formed f
        join (select word, arg_max(here, depth) as root from steps group by word) r on f.word = r.word""",
)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Near words, form and root of every word of the documents, after one letter in some of the runs was lost."""
    runs = spelling.letter_runs(table(spark, folder, "documents"))
    return spelling.group_variants(spelling.vocabulary(spelling.plant_deletions(runs, DAMAGED_SHARE)))


@query(
    "op12_phrase_collocations",
    rf"""with pieces as (select coalesce(lang, 'und') as lang,
            unnest(string_split_regex(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'), '{collocations.PIECE_ENDS}')) as piece from documents),
        cut as (select lang, regexp_extract_all(piece, '[^ \x09]+') as w from pieces),
        spans as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest(range(1, 5)) as k from cut) s where len(w) >= k),
        f as (select lang, k, w[i:i + k - 1] as p, count(*) as a from spans group by all),
        totals as (select lang, sum(len(w)) as n from cut group by lang),
        c as (select * from f where k >= 2 and a >= 30),
        cuts as (select lang, p, k, a, unnest(range(1, k)) as j from c),
        scores as (select cuts.*, x.a as l, y.a as r, (2000000::hugeint * cuts.a) // (x.a + y.a) as score from cuts
            join f x on x.lang = cuts.lang and x.p = cuts.p[1:j] join f y on y.lang = cuts.lang and y.p = cuts.p[j + 1:]),
        least_cut as (select lang, p, first(struct_pack(a := a, l := l, r := r, score := score) order by score, j) as s from scores group by lang, p),
        sizes as (select lang, p, a, k, unnest(range(2, k)) as m from c where k > 2),
        inner_spans as (select lang, p, a, m, unnest(range(1, k - m + 2)) as i from sizes),
        held as (select lang, p[i:i + m - 1] as p, max(a) as held from inner_spans group by all),
        kept as (select o.lang, array_to_string(o.p, ' ') as phrase, s.a as a, s.l as l, s.r as r, cast(s.score as bigint) as score from least_cut o
            left join held h on h.lang = o.lang and h.p = o.p where h.held is null or 100 * h.held < 80 * s.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select ranked.lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join totals on ranked.lang = totals.lang where rank <= 2000""",
)
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of two to four words per language."""
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_curve_packing")
def op13_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and where each lies in sequences of neighbouring documents."""
    return curve_packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_VOCABULARY), PACKED_END_ID, CURVE_TOKENS)
