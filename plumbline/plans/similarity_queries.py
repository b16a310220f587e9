"""Duplicates, similarity, links, secrets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import graph
from plumbline.operators import similarity as M
from plumbline.plans.registry import query

PERMS, ROWS = 8, 4
WORDS = "with t as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') w from benchmark), s as (select item_id, case when len(w) < 5 then [] else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end sh from t)"
SIG = WORDS + f", g as (select item_id, list_transform(range(0, {PERMS}), lambda p: list_min(list_transform(sh, lambda x: ('0x' || substr(md5(p::varchar || ':' || x), 1, 8))::bigint))) sig from s where len(sh) > 0)"
BANDS = SIG + f""", r as (select sig, min(item_id) rep from g group by 1), b as (select rep, unnest(range(0, {PERMS // ROWS})) band, sig from r), k as (select rep, band, array_to_string(sig[band * {ROWS} + 1:band * {ROWS} + {ROWS}], ',') v from b),
pairs as (select distinct x.rep a, y.rep b from k x join k y on x.band = y.band and x.v = y.v and x.rep < y.rep union all select rep, item_id from g join r using (sig) where item_id <> rep)"""


def _sigs(t):
    rows = t("benchmark").select("item_id", M.shingles(M.tokens(F.col("text"))).alias("sh")).where(F.size("sh") > 0)
    return rows.select("item_id", M.minhash(F.col("sh"), PERMS).alias("sig"))


@query("with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') w from documents) select doc_id, len(w)::bigint as n_tokens, len(list_distinct(w))::bigint as n_distinct from w")
def tokenize_counts(t):
    return t("documents").select("doc_id", M.tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("with h as (select doc_id, source, sha256(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''), ' ')) h from documents) select h as hash, count(*) as n, count(distinct source) as sources, min(doc_id) as first_doc from h group by 1 having count(distinct source) >= 2")
def exact_duplicates(t):
    h = F.sha2(F.array_join(M.tokens(F.col("text")), " "), 256)
    return t("documents").groupBy(h.alias("hash")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.min("doc_id").alias("first_doc")).where("sources >= 2")


@query(SIG + " select item_id, array_to_string(sig, ',') as sig from g")
def minhash_signature(t):
    return _sigs(t).select("item_id", F.array_join("sig", ",").alias("sig"))


@query(BANDS + " select a, b from pairs")
def lsh_candidates(t):
    return M.lsh_pairs(_sigs(t), "item_id", "sig", ROWS, PERMS)


@query("with recursive " + BANDS.removeprefix("with ") + ", e as (select a, b from pairs union select b, a from pairs), c(id, m) as (select a, a from e union select e.b, c.m from c join e on c.id = e.a) select id, min(m) as cluster from c group by 1")
def duplicate_clusters(t):
    return graph.clusters(M.lsh_pairs(_sigs(t), "item_id", "sig", ROWS, PERMS))


@query("""with t as (select item_id id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') w from benchmark), s as (select id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) x from t where len(w) >= 5),
u as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') w from documents), d as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) x from u where len(w) >= 5), n as (select id, count(*) n from s group by 1)
select id as item_id, doc_id, round(count(*)::double / max(n), 6) as containment from s join d using (x) join n using (id) group by 1, 2 having count(*)::double / max(n) >= 0.5""")
def shingle_containment(t):
    """Documents that hold at least half the shingles of a benchmark item."""
    s = t("benchmark").select("item_id", M.shingles(M.tokens(F.col("text"))).alias("sh")).withColumn("n", F.size("sh")).select("item_id", "n", F.explode("sh").alias("x"))
    d = t("documents").select("doc_id", F.explode(M.shingles(M.tokens(F.col("text")))).alias("x"))
    hits = d.join(s, "x")
    return hits.groupBy("item_id", "doc_id").agg((F.count("*") / F.max("n")).alias("c")).where("c >= 0.5").select("item_id", "doc_id", F.round("c", 6).alias("containment"))


@query()
def lcs_verified_pairs(t):
    """LSH candidates of the benchmark, verified by their longest common subsequence."""
    words = t("benchmark").select("item_id", M.tokens(F.col("text")).alias("w"))
    pairs = M.lsh_pairs(_sigs(t), "item_id", "sig", ROWS, PERMS)
    both = pairs.join(words.select(F.col("item_id").alias("a"), F.col("w").alias("wa")), "a").join(words.select(F.col("item_id").alias("b"), F.col("w").alias("wb")), "b")
    return both.select("a", "b", M.lcs_similarity("wa", "wb").alias("lcs")).where("lcs >= 0.7")


def _document_sigs(t):
    return graph.cut(M.text_signatures(t("documents"), "doc_id", "text"))


@query()
def document_signatures(t):
    """The reference's 128 hashes for every document that has a shingle."""
    return _document_sigs(t)


@query()
def document_lsh_candidates(t):
    """Documents that share one of 16 bands of 8 hashes; rows of one signature are linked to the smallest."""
    return M.wide_pairs(_document_sigs(t), "doc_id", "sig")


@query()
def document_clusters(t):
    """Components of ``document_lsh_candidates``."""
    return graph.clusters(M.wide_stars(_document_sigs(t), "doc_id", "sig"))


@query()
def document_lcs_pairs(t):
    """All pairs of documents whose longest common subsequence of words is .7 of their mean length or more."""
    return M.lcs_pairs(t("documents").select("doc_id", M.tokens(F.col("text")).alias("w")), "doc_id", "w")


EVERY_20 = "with e as (select vec_id, embedding::double[] v from embeddings), c as (select q.vec_id query_id, e.vec_id, round(list_cosine_similarity(e.v, q.v), 12) c from e, e q where q.vec_id % 20 = 0 and e.vec_id <> q.vec_id)"


def _all_cosines(t):
    rows = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return M.block_cosines(rows, rows.where("vec_id % 20 = 0"), 20, 0.72, 0.9)


@query(EVERY_20 + " select query_id, vec_id, round(c, 3) as cosine from c qualify row_number() over (partition by query_id order by c desc, vec_id) <= 20")
def cosine_topk(t):
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return _all_cosines(t)[0].select("query_id", "vec_id", F.round("c", 3).alias("cosine"))


@query(EVERY_20 + " select query_id, count(*) filter (c >= 0.72 and c < 0.9) as in_band from c group by 1")
def cosine_band(t):
    return _all_cosines(t)[1]


@query("select doc_id, len(regexp_extract_all(text, '[a-z0-9.]+@[a-z0-9.]+'))::bigint as mails, len(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}'))::bigint as ips, md5(regexp_replace(text, '[a-z0-9.]+@[a-z0-9.]+', '[mail]', 'g')) as masked_md5 from documents")
def secret_mask_counts(t):
    mail, ip = "[a-z0-9.]+@[a-z0-9.]+", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
    return t("documents").select("doc_id", F.regexp_count("text", F.lit(mail)).cast("long").alias("mails"), F.regexp_count("text", F.lit(ip)).cast("long").alias("ips"), F.md5(F.regexp_replace("text", mail, "[mail]")).alias("masked_md5"))


LINKS = "with l as (select distinct page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) target from pages)"


def _links(t):
    return t("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))).alias("target"))


@query(LINKS + " select target, count(*) as in_degree, min(page_id) as first_page from l group by 1")
def page_link_graph(t):
    return _links(t).groupBy("target").agg(F.count("*").alias("in_degree"), F.min("page_id").alias("first_page"))


@query(LINKS + " select page_id, url from pages p where not exists (select 1 from l where l.target = p.url)")
def orphan_pages(t):
    return t("pages").join(_links(t), F.col("url") == F.col("target"), "left_anti").select("page_id", "url")


@query("""with s as (select distinct regexp_extract(url, '^(https?://[^/]+)', 1) scope from pages union select distinct regexp_extract(url, '^(https?://[^/]+/[^/]+)/', 1) from pages)
select page_id, arg_max(scope, length(scope)) as scope from pages join s on scope <> '' and (url = scope or starts_with(url, scope || '/')) group by 1""")
def prefix_asof(t):
    """The deepest scope above each page, with the scopes of all pages."""
    pages = t("pages").select("page_id", "url")
    hosts, dirs = (pages.select(F.regexp_extract("url", p, 1).alias("scope")) for p in ("^(https?://[^/]+)", "^(https?://[^/]+/[^/]+)/"))
    scopes = hosts.unionByName(dirs).where("scope <> ''").distinct()
    parts = F.split("url", "/")
    above = F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return pages.select("page_id", F.explode(F.array_distinct(above)).alias("scope")).join(scopes, "scope").groupBy("page_id").agg(F.max_by("scope", F.length("scope")).alias("scope"))


@query("select l.label, count(*) as n, round(avg(len(e.embedding)), 2) as width, min(e.vec_id) as first_id from embeddings e join (select distinct label from embeddings) l on e.label = l.label group by 1")
def embedding_index(t):
    e = t("embeddings")
    return e.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size("embedding")), 2).alias("width"), F.min("vec_id").alias("first_id"))


@query("""with u as (select conv_id, turn, role, text, lead(role) over (partition by conv_id order by turn) nr, lead(turn) over (partition by conv_id order by turn) nt from conversations)
select conv_id, turn as asked, nt as answered, length(text)::bigint as prompt_chars from u where role = 'user' and nr = 'assistant'""")
def turn_pairs(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t("conversations").withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("turn").over(w))
    return rows.where("role = 'user' and nr = 'assistant'").select("conv_id", F.col("turn").alias("asked"), F.col("nt").alias("answered"), F.length("text").cast("long").alias("prompt_chars"))
