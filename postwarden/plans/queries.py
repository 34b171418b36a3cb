"""The operators applied to the driver's tables, each with SQL that must give the same rows.

``T(spark, sf_dir, name)`` reads a table. Outputs are scalars, so that both engines can be
compared value by value; sums of doubles are taken in sorted order or avoided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import addresses as A
from ..functions import domains as D
from ..functions import filenames as N
from ..functions import links as L
from ..functions import redaction, style
from ..functions.mail import order_hash
from ..functions.markup import page
from ..lexicons import CREDENTIAL_WORDS, EXTENSIONS, FREE_HOSTING, FREEMAIL, FUNCTION_WORDS, RELIEF, SEVERITIES
from ..operators import contacts as G
from ..operators import evaluation as V
from ..operators import findings as FI
from ..operators import profiles as P
from ..operators import rules as R
from ..operators import sync as S
from . import reports

QUERIES: dict = {}
ORACLES: dict = {}
C = F.col


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- links and domains

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"


def _links(spark, sf_dir) -> DataFrame:
    return T(spark, sf_dir, "pages").select("page_id", L.dissect(C("url")).alias("l"))


@query(f"""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, {_HOST} AS host, {_PATH} AS path, {_QUERY} AS query,
 {D.sql_org(_HOST)} AS org, split_part({D.sql_org(_HOST)}, '.', 1) AS label, {_HOST} IN ('bit.ly','t.co') AS is_shortener FROM pages""")
def url_dissect(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", *[C(f"l.{c}").alias(c) for c in ("scheme", "host", "path", "query", "org")], D.name_label("l.host").alias("label"), L.is_shortener(C("l")).alias("is_shortener"))


@query(f"SELECT org, count(*) AS n_pages, count(DISTINCT host) AS n_hosts, max(page_id) AS last_page FROM (SELECT page_id, {_HOST} AS host, {D.sql_org(_HOST)} AS org FROM pages) GROUP BY org")
def org_domain_rollup(spark, sf_dir):
    return _links(spark, sf_dir).groupBy(C("l.org").alias("org")).agg(F.count("*").alias("n_pages"), F.countDistinct("l.host").alias("n_hosts"), F.max("page_id").alias("last_page"))


@query(f"""SELECT {_HOST} AS host, {D.sql_org(_HOST)} IN ({D.sql_list(FREEMAIL)}) AS is_freemail,
 list_has_any([{_HOST}, {D.sql_tail(_HOST, 2)}, {D.sql_tail(_HOST, 3)}, {D.sql_tail(_HOST, 4)}], [{D.sql_list(FREE_HOSTING)}]) AS on_free_hosting, count(*) AS n FROM pages GROUP BY 1, 2, 3""")
def host_classes(spark, sf_dir):
    rows = _links(spark, sf_dir).select(C("l.host").alias("host"), D.is_freemail("l.host").alias("is_freemail"), L.free_hosting(C("l")).isNotNull().alias("on_free_hosting"))
    return rows.groupBy("host", "is_freemail", "on_free_hosting").agg(F.count("*").alias("n"))


@query("""SELECT page_id, count(*) AS n_links, count(DISTINCT h) AS n_distinct FROM
 (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h FROM pages) GROUP BY page_id""")
def link_extract_counts(spark, sf_dir):
    found = T(spark, sf_dir, "pages").select("page_id", F.explode(page("html")["links"]["href"]).alias("h"))
    return found.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("h").alias("n_distinct"))


@query()
def page_visible_text(spark, sf_dir):
    p = T(spark, sf_dir, "pages").withColumn("p", page("html"))
    return p.select("page_id", F.size("p.links").cast("long").alias("n_links"), F.length("p.visible_text").alias("visible_chars"), F.length("p.hidden_text").alias("hidden_chars"), F.sha2("p.visible_text", 256).alias("visible_sha"), C("p.script_count").alias("scripts"))


@query(rf"""SELECT page_id, i::INTEGER AS position, split_part(p, '=', 1) AS key, regexp_extract(p, '^[^=]*=(.*)$', 1) AS value FROM
 (SELECT page_id, unnest(q) AS p, unnest(range(len(q))) AS i FROM (SELECT page_id, list_filter(string_split({_QUERY}, '&'), lambda x: regexp_matches(x, '^[^=]*=.+')) AS q FROM pages))""")
def url_query_params(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.posexplode(L.query_params(C("l.query"))).alias("position", "p")).select("page_id", "position", "p.key", "p.value")


_CRED = ",".join(f"'{w}'" for w in CREDENTIAL_WORDS)


@query(rf"""SELECT page_id, array_to_string(list_sort(list_intersect(list_distinct(regexp_split_to_array(lower({_PATH} || ' ' || {_QUERY}), '[^a-z0-9]+')), [{_CRED}])), ',') AS words FROM pages""")
def credential_words(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", F.array_join(L.credential_words(C("l")), ",").alias("words"))


@query(r"""SELECT page_id, regexp_extract(u, '&?(url|next|to|r|u|link|out)=(https?%3A[^&#]*)', 2) AS target FROM
 (SELECT page_id, 'https://x.example/?url=https%3A%2F%2F' || regexp_extract(url, '://([^/?#:]*)', 1) AS u FROM pages)""".replace("regexp_extract(u, '&?(url|next|to|r|u|link|out)=(https?%3A[^&#]*)', 2)", "replace(replace(regexp_extract(u, '=(.*)$', 1), '%3A', ':'), '%2F', '/')"))
def open_redirect(spark, sf_dir):
    made = F.concat(F.lit("https://x.example/?url=https%3A%2F%2F"), C("l.host"))
    return _links(spark, sf_dir).select("page_id", L.redirect_target(L.dissect(made)).alias("target"))


@query(f"SELECT p_partkey, {D.sql_skeleton('p_name')} AS name_skeleton, {D.sql_skeleton('p_brand')} AS brand_skeleton FROM part")
def visual_skeleton(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", D.skeleton("p_name").alias("name_skeleton"), D.skeleton("p_brand").alias("brand_skeleton"))


_PAIRS = f"""SELECT DISTINCT {_HOST} AS host FROM pages"""


@query(f"""WITH h AS ({_PAIRS}), l AS (SELECT host, split_part(host, '.', 1) AS label FROM h WHERE len(split_part(host, '.', 1)) >= 5)
SELECT a.label || '.com' AS candidate, b.label || '.net' AS known, 'typo' AS kind, 0.85::DOUBLE AS confidence FROM (SELECT DISTINCT label FROM l) a JOIN (SELECT DISTINCT label FROM l) b
ON a.label <> b.label AND damerau_levenshtein(a.label, b.label) = 1 AND {D.sql_skeleton('a.label')} <> {D.sql_skeleton('b.label')}""")
def lookalike_typos(spark, sf_dir):
    labels = _links(spark, sf_dir).select(F.substring_index("l.host", ".", 1).alias("label")).where(F.length("label") >= 5).distinct()
    cands = labels.select("label", F.concat("label", F.lit(".com")).alias("candidate"), F.explode(D.blocking_keys("candidate")("label")).alias("key"))
    known = labels.select(C("label").alias("k_label"), F.concat("label", F.lit(".net")).alias("known"), F.explode(D.blocking_keys("known")("label")).alias("key"))
    pairs = cands.join(known, "key").where("label <> k_label").select("candidate", "known", "label", "k_label").distinct()
    found = pairs.withColumn("d", D.edits_of("label", "k_label")).where("d = 1").withColumn("i", D.imitation("candidate", "known", C("d"))).where("i.kind = 'typo'")
    return found.select("candidate", "known", C("i.kind").alias("kind"), C("i.confidence").alias("confidence"))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), s AS (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h)
SELECT array_to_string(string_split(host, '.')[i:], '.') AS suffix, count(*) AS n_hosts FROM s GROUP BY 1""")
def host_suffixes(spark, sf_dir):
    hosts = _links(spark, sf_dir).select(C("l.host").alias("host")).distinct().withColumn("parts", F.split("host", r"\."))
    each = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.lit(64)), "."))).alias("suffix"))
    return each.groupBy("suffix").agg(F.count("*").alias("n_hosts"))


# ---------------------------------------------------------------- addresses and names

_MAILS = r"SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}'))) AS a FROM documents"


@query(f"SELECT doc_id, a AS address, {A.sql_canonical('a')} AS canonical, {A.sql_domain_of('a')} AS domain, {D.sql_org(A.sql_domain_of('a'))} AS org FROM ({_MAILS})")
def address_canonical(spark, sf_dir):
    found = T(spark, sf_dir, "documents").select("doc_id", F.explode(A.emails_in("text")).alias("address"))
    return found.select("doc_id", "address", A.canonical_address("address").alias("canonical"), A.domain_of("address").alias("domain"), D.org_domain(A.domain_of("address")).alias("org"))


_MADE = "CASE WHEN c_custkey % 3 = 0 THEN 'C.' || c_custkey || '+news@GoogleMail.com' WHEN c_custkey % 3 = 1 THEN 'User.' || c_custkey || '@Mail.Shop' || c_nationkey || '.co.uk' ELSE 'c' || c_custkey END"


@query(f"SELECT c_custkey, {A.sql_canonical('a')} AS canonical, {D.sql_org(A.sql_domain_of('a'))} AS org FROM (SELECT c_custkey, {_MADE} AS a FROM customer)")
def address_forms(spark, sf_dir):
    rows = T(spark, sf_dir, "customer").select("c_custkey", F.expr(_MADE).alias("a"))
    return rows.select("c_custkey", A.canonical_address("a").alias("canonical"), D.org_domain(A.domain_of("a")).alias("org"))


@query(f"SELECT 'part' AS t, p_partkey AS id, {A.sql_name_key('p_name')} AS key FROM part UNION ALL SELECT 'customer', c_custkey, {A.sql_name_key('c_name')} FROM customer UNION ALL SELECT 'supplier', s_suppkey, {A.sql_name_key('s_name')} FROM supplier")
def display_name_key(spark, sf_dir):
    of = lambda t, i, n: T(spark, sf_dir, t).select(F.lit(t).alias("t"), C(i).alias("id"), A.name_key(n).alias("key"))
    return of("part", "p_partkey", "p_name").union(of("customer", "c_custkey", "c_name")).union(of("supplier", "s_suppkey", "s_name"))


# ---------------------------------------------------------------- contact graph: a customer is a contact, an order a message

_GRAPH = """WITH g AS (SELECT o_custkey AS contact, count(*) FILTER (o_orderstatus = 'F') AS inbound_count, count(*) FILTER (o_orderstatus <> 'F') AS outbound_count,
 min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY o_custkey),
t AS (SELECT *, inbound_count + 3 * outbound_count AS affinity, floor((least(1.0::DOUBLE, outbound_count / 2.0::DOUBLE) * 0.6::DOUBLE + least(1.0::DOUBLE, inbound_count / 10.0::DOUBLE) * 0.4::DOUBLE) * 1000 + 0.5) / 1000 AS trust,
 (outbound_count > 0 OR inbound_count >= 3) AS reference_grade FROM g) """


def _people(spark, sf_dir) -> DataFrame:
    events = T(spark, sf_dir, "orders").select(F.lit(1).alias("account_id"), C("o_orderkey").cast("string").alias("gmail_id"), C("o_orderdate").alias("received_at"), (C("o_orderstatus") != "F").alias("outbound"), C("o_custkey").cast("string").alias("canonical_email"), F.lit("").alias("name"))
    return G.contacts(events)


def _graph(spark, sf_dir):
    people = _people(spark, sf_dir)
    return people.select(C("canonical_email").cast("long").alias("contact"), "inbound_count", "outbound_count", "first_seen", "last_seen", G.affinity().alias("affinity"), G.trust().alias("trust"), G.reference_grade().alias("reference_grade"))


@query(_GRAPH + "SELECT * FROM t")
def contact_graph(spark, sf_dir):
    return _graph(spark, sf_dir)


@query(_GRAPH + "SELECT contact, affinity, trust FROM t ORDER BY affinity DESC, contact LIMIT 30")
def top_contacts(spark, sf_dir):
    return _graph(spark, sf_dir).select("contact", "affinity", "trust").orderBy(F.desc("affinity"), "contact").limit(30)


@query(_GRAPH + "SELECT n_name AS org, max(trust) AS trust, count(*) AS n_contacts FROM t JOIN customer ON contact = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE reference_grade GROUP BY n_name")
def reference_domains(spark, sf_dir):
    place = F.concat(F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit(".example"))
    homes = T(spark, sf_dir, "customer").join(T(spark, sf_dir, "nation"), C("c_nationkey") == C("n_nationkey")).select(C("c_custkey").cast("string").alias("canonical_email"), place.alias("domain"), "n_name")
    people = _people(spark, sf_dir).drop("domain").join(homes, "canonical_email")
    found = G.reference_domains(people, spark.createDataFrame([], "account_id int, email string"))
    sizes = people.where(G.reference_grade()).groupBy(C("domain").alias("org"), "n_name").agg(F.count("*").alias("n_contacts"))
    return found.join(sizes, "org").select(C("n_name").alias("org"), "trust", "n_contacts")


@query(_GRAPH + f", k AS (SELECT {A.sql_name_key('c_name')} AS key, contact, trust FROM t JOIN customer ON contact = c_custkey WHERE reference_grade) SELECT key, count(*) AS n_contacts, max(trust) AS best_trust, min(contact) AS first_contact FROM k WHERE len(key) >= 3 GROUP BY key")
def reference_names(spark, sf_dir):
    names = T(spark, sf_dir, "customer").select(C("c_custkey").cast("string").alias("canonical_email"), F.array("c_name").alias("display_names"))
    rows = G.reference_names(_people(spark, sf_dir).drop("display_names").join(names, "canonical_email"))
    return rows.groupBy("key").agg(F.count("*").alias("n_contacts"), F.max("trust").alias("best_trust"), F.min(C("canonical_email").cast("long")).alias("first_contact"))


@query("SELECT count(*) AS messages, count(DISTINCT o_custkey) AS contacts, count(*) FILTER (o_orderstatus = 'F') AS received, count(*) FILTER (o_orderstatus <> 'F') AS sent, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders")
def store_stats(spark, sf_dir):
    labels = F.when(C("o_orderstatus") == "F", F.array(F.lit("INBOX"))).otherwise(F.array(F.lit("SENT")))
    mail = T(spark, sf_dir, "orders").select(labels.alias("labels"), C("o_orderdate").alias("received_at"), F.lit(None).cast("string").alias("parse_error"))
    return reports.stats(mail, _people(spark, sf_dir)).select("messages", "contacts", "received", "sent", "first_at", "last_at")


@query("SELECT coalesce(l_returnflag, '(none)') AS dmarc, count(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def auth_breakdown(spark, sf_dir):
    rows = T(spark, sf_dir, "orders").join(T(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), C("o_orderkey") == C("l_orderkey"), "left")
    return reports.auth_breakdown(rows.select(F.struct(C("l_returnflag").alias("dmarc")).alias("auth")))


# ---------------------------------------------------------------- fusion: an order is a message, a line a finding

_SEV = "CASE WHEN l_quantity <= 10 THEN 'info' WHEN l_quantity <= 20 THEN 'low' WHEN l_quantity <= 30 THEN 'medium' WHEN l_quantity <= 40 THEN 'high' ELSE 'critical' END"
_RANK = "CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END"
_NOR = "1.0::DOUBLE - list_reduce(list_prepend(1.0::DOUBLE, list_sort({w})), lambda a, x: a * (1.0::DOUBLE - x))"
_FUSE = f"""WITH f AS (SELECT l_orderkey AS message_id, l_returnflag || l_linestatus AS code, (l_linenumber % 4)::INTEGER AS layer, {_SEV} AS severity, {_RANK} AS r, l_discount * 5 AS weight, l_returnflag = 'N' AS mitigating FROM lineitem),
ly AS (SELECT message_id, layer, {_NOR.format(w="list(weight) FILTER (NOT mitigating)")} AS s, max(r) FILTER (NOT mitigating) AS worst FROM f GROUP BY message_id, layer HAVING count(*) FILTER (NOT mitigating) > 0),
mt AS (SELECT message_id, {_NOR.format(w="list(weight)")} AS m FROM f WHERE mitigating GROUP BY message_id),
tm AS (SELECT ly.message_id, s * (1 - least(coalesce(m, 0.0::DOUBLE), [0.9::DOUBLE, 0.8, 0.55, 0.25, 0.05][worst + 1])) AS term FROM ly LEFT JOIN mt ON ly.message_id = mt.message_id),
sc AS (SELECT message_id, {_NOR.format(w="list(term)")} AS raw FROM tm GROUP BY message_id),
v AS (SELECT i.message_id, floor(coalesce(raw, 0.0::DOUBLE) * 1e4 + 0.5) / 1e4 AS score FROM (SELECT DISTINCT message_id FROM f) i LEFT JOIN sc ON i.message_id = sc.message_id),
vt AS (SELECT *, CASE WHEN score >= 0.7 THEN 'danger' WHEN score >= 0.28 THEN 'caution' ELSE 'safe' END AS tier FROM v) """


def _lines(spark, sf_dir) -> DataFrame:
    severity = F.expr(_SEV)
    f = FI.finding(F.concat("l_returnflag", "l_linestatus"), 0, severity, C("l_discount") * 5, "finding")
    f = f.withField("layer", (C("l_linenumber") % 4).cast("int")).withField("mitigating", C("l_returnflag") == "N").cast(FI.FINDING)
    return T(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("message_id"), f.alias("f"))


def _verdicts(spark, sf_dir) -> DataFrame:
    rows = _lines(spark, sf_dir).groupBy("message_id").agg(F.collect_list("f").alias("findings"))
    return FI.with_verdict(rows)


@query(_FUSE + "SELECT message_id, score, tier FROM vt")
def noisy_or_fusion(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("message_id", "score", "tier")


@query(_FUSE + "SELECT tier, count(*) AS n FROM vt GROUP BY tier")
def tier_histogram(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))


@query(_FUSE + "SELECT message_id, score, tier, o_orderdate AS received_at FROM vt JOIN orders ON message_id = o_orderkey WHERE tier <> 'safe' ORDER BY score DESC, received_at DESC, message_id LIMIT 25")
def flagged(spark, sf_dir):
    rows = _verdicts(spark, sf_dir).select("message_id", "score", "tier").where("tier <> 'safe'").join(T(spark, sf_dir, "orders"), C("message_id") == C("o_orderkey"))
    return rows.select("message_id", "score", "tier", C("o_orderdate").alias("received_at")).orderBy(F.desc("score"), F.desc("received_at"), "message_id").limit(25)


@query(_FUSE + "SELECT message_id, count(*) AS n_band FROM vt WHERE score BETWEEN 0.20 AND 0.80 GROUP BY message_id")
def band_gate(spark, sf_dir):
    return _verdicts(spark, sf_dir).where(R.in_band(C("score"))).groupBy("message_id").agg(F.count("*").alias("n_band"))


@query(_FUSE + "SELECT code, count(*) AS n, max(r)::INTEGER AS worst FROM f WHERE NOT mitigating AND weight > 0 GROUP BY code ORDER BY n DESC, code LIMIT 20")
def finding_topcodes(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("not f.mitigating and f.weight > 0")
    return rows.groupBy(C("f.code").alias("code")).agg(F.count("*").alias("n"), F.max(FI.rank(C("f.severity"))).cast("int").alias("worst")).orderBy(F.desc("n"), "code").limit(20)


@query(_FUSE + ", w AS (SELECT message_id, layer, code, CASE WHEN mitigating THEN -weight ELSE weight END AS weight FROM f) SELECT message_id, layer, code, weight, count(*) AS copies FROM w WHERE abs(weight) >= 0.4 GROUP BY ALL")
def verdict_detail(spark, sf_dir):
    rows = FI.long_findings(_verdicts(spark, sf_dir)).where(F.abs("weight") >= 0.4)
    return rows.groupBy("message_id", "layer", "code", "weight").agg(F.count("*").alias("copies"))


# ---------------------------------------------------------------- evaluation: rated documents, scored by a rule

_RULE = r"least(1.0::DOUBLE, (length(text) - length(regexp_replace(text, '[0-9!#$%&*|]', '', 'g'))) / 200.0::DOUBLE)"
_SAMPLES = f"WITH s AS (SELECT l.doc_id, l.toxic = 1 OR l.quality = 0 AS attack, l.quality, {_RULE} AS score FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "
_METRICS = """tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE floor(tp * 1e4 / (tp + fp) + 0.5) / 1e4 END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE floor(tp * 1e4 / (tp + fn) + 0.5) / 1e4 END AS recall,
 CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE floor(2 * tp * 1e4 / (2 * tp + fp + fn) + 0.5) / 1e4 END AS f1, CASE WHEN fp + tn = 0 THEN 0.0 ELSE floor(fp * 1e4 / (fp + tn) + 0.5) / 1e4 END AS fpr"""
_SWEEP = _SAMPLES + f""", w AS (SELECT t / 20.0::DOUBLE AS threshold, count(*) FILTER (attack AND score >= t / 20.0::DOUBLE) AS tp, count(*) FILTER (NOT attack AND score >= t / 20.0::DOUBLE) AS fp,
 count(*) FILTER (NOT attack AND score < t / 20.0::DOUBLE) AS tn, count(*) FILTER (attack AND score < t / 20.0::DOUBLE) AS fn FROM s, range(1, 20) r(t) GROUP BY t), m AS (SELECT threshold, {_METRICS} FROM w) """


def _samples(spark, sf_dir) -> DataFrame:
    marks = F.length("text") - F.length(F.regexp_replace("text", "[0-9!#$%&*|]", ""))
    rows = T(spark, sf_dir, "labels").join(T(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", ((C("toxic") == 1) | (C("quality") == 0)).alias("attack"), "quality", F.least(F.lit(1.0), marks / 200.0).alias("score"))


@query(_SAMPLES + f", w AS (SELECT count(*) FILTER (attack AND score >= 0.28) AS tp, count(*) FILTER (NOT attack AND score >= 0.28) AS fp, count(*) FILTER (NOT attack AND score < 0.28) AS tn, count(*) FILTER (attack AND score < 0.28) AS fn FROM s) SELECT {_METRICS} FROM w")
def confusion_metrics(spark, sf_dir):
    return V.metrics(_samples(spark, sf_dir), C("score") >= FI.CAUTION)


@query(_SWEEP + "SELECT * FROM m")
def threshold_sweep(spark, sf_dir):
    return V.sweep(_samples(spark, sf_dir), 20)


@query(_SWEEP + "SELECT * FROM (SELECT 'best_f1' AS choice, * FROM m ORDER BY f1 DESC, threshold LIMIT 1) UNION ALL SELECT * FROM (SELECT 'precise' AS choice, * FROM m WHERE \"precision\" >= 0.95 ORDER BY recall DESC, threshold LIMIT 1)")
def best_threshold(spark, sf_dir):
    return V.best(V.sweep(_samples(spark, sf_dir), 20))


@query(_SAMPLES + f", w AS (SELECT quality, count(*) FILTER (attack AND score >= 0.28) AS tp, count(*) FILTER (NOT attack AND score >= 0.28) AS fp, count(*) FILTER (NOT attack AND score < 0.28) AS tn, count(*) FILTER (attack AND score < 0.28) AS fn FROM s GROUP BY quality) SELECT quality, {_METRICS} FROM w")
def metrics_by_transform(spark, sf_dir):
    return V.metrics(_samples(spark, sf_dir), C("score") >= FI.CAUTION, "quality")


_UPTO = f"""WITH f AS (SELECT l_orderkey AS message_id, (l_linenumber % 4)::INTEGER AS layer, l_discount * 5 AS weight FROM lineitem WHERE l_returnflag <> 'N'),
u AS (SELECT k AS upto, message_id, {_NOR.format(w="list(weight)")} AS raw FROM f JOIN range(0, 4) r(k) ON layer <= k GROUP BY k, message_id)
SELECT upto::INTEGER AS upto, count(*) FILTER (raw >= 0.28) AS flagged, count(*) AS scored FROM u GROUP BY upto"""


@query(_UPTO)
def layer_ablation(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("not f.mitigating").select("message_id", C("f.layer").alias("layer"), C("f.weight").alias("weight"))
    return V.ablation(rows, 3)


# ---------------------------------------------------------------- style and profiles

@query(r"""SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(list_transform(w, lambda x: lower(x))))::BIGINT AS n_distinct, len(list_filter(w, lambda x: lower(x) IN (""" + D.sql_list(FUNCTION_WORDS) + r""")))::BIGINT AS n_function,
 (length(t) - length(replace(t, ',', '')))::BIGINT AS commas, (length(t) - length(replace(t, '.', '')))::BIGINT AS periods, len(list_filter(w, lambda x: len(x) > 1 AND regexp_matches(x, '^[A-Z'']+$')))::BIGINT AS shouted
FROM (SELECT doc_id, text AS t, regexp_extract_all(text, '[a-zA-Z'']+') AS w FROM documents)""")
def style_counts(spark, sf_dir):
    w, count = C("w"), lambda m: (F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))).cast("long")
    rows = T(spark, sf_dir, "documents").withColumn("w", F.regexp_extract_all("text", F.lit("[a-zA-Z']+"), F.lit(0)))
    return rows.select(
        "doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(F.transform(w, F.lower))).cast("long").alias("n_distinct"), F.size(F.filter(w, lambda x: F.lower(x).isin(*FUNCTION_WORDS))).cast("long").alias("n_function"),
        count(",").alias("commas"), count(".").alias("periods"), F.size(F.filter(w, lambda x: (F.length(x) > 1) & x.rlike("^[A-Z']+$"))).cast("long").alias("shouted"),
    )


@query()
def style_features(spark, sf_dir):
    rows = T(spark, sf_dir, "documents").select("doc_id", style.style("text").alias("s"))
    return rows.select("doc_id", "s.words", "s.greeting", "s.signoff", F.sha2(F.to_json("s.vector"), 256).alias("vector_sha"), F.size("s.vector").alias("dims"))


@query("""WITH w AS (SELECT source, lower(unnest(regexp_extract_all(text, '[a-zA-Z'']+'))) AS w FROM documents WHERE lang = 'en') SELECT source, w AS word, count(*) AS n FROM w WHERE w IN (""" + D.sql_list(FUNCTION_WORDS) + ") GROUP BY source, w")
def function_word_profile(spark, sf_dir):
    words = T(spark, sf_dir, "documents").where("lang = 'en'").select("source", F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z']+"), F.lit(0))).alias("w"))
    return words.select("source", F.lower("w").alias("word")).where(C("word").isin(*FUNCTION_WORDS)).groupBy("source", "word").agg(F.count("*").alias("n"))


@query()
def style_fit(spark, sf_dir):
    rows = T(spark, sf_dir, "embeddings").select("label", C("vec_id"), C("embedding").cast("array<double>").alias("vector"))
    return P.fit_vectors(rows, ["label"], "vec_id").select("label", "mean", "sd", "n", F.size("centroid").alias("dims"))


@query("""WITH e AS (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) SELECT label, (i - 1)::INTEGER AS at, sum(floor(embedding[i]::DOUBLE * 1e6)::BIGINT)::BIGINT AS total, count(*) AS n FROM e GROUP BY label, i""")
def style_centroid_sums(spark, sf_dir):
    parts = T(spark, sf_dir, "embeddings").select("label", F.posexplode(C("embedding").cast("array<double>")).alias("at", "x"))
    return parts.groupBy("label", "at").agg(F.sum(F.floor(C("x") * 1e6)).alias("total"), F.count("*").alias("n"))


@query(r"""SELECT conv_id, turn, role, CASE WHEN regexp_matches(text, '(?i)^\s*(hi|hello|hey|dear|yo|morning)\b') THEN lower(regexp_extract(text, '(?i)^\s*(hi|hello|hey|dear|yo|morning)\b', 1)) ELSE '' END AS greeting FROM conversations""")
def greeting_words(spark, sf_dir):
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lower(F.regexp_extract("text", r"(?i)^\s*(hi|hello|hey|dear|yo|morning)\b", 1)).alias("greeting"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, n, n / (sum(n) OVER (PARTITION BY user_id))::DOUBLE AS share, n >= 2 AS is_known FROM c""")
def histogram_share_known(spark, sf_dir):
    counts = T(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("h"))
    each = maps.select("user_id", "h", F.explode("h").alias("event_type", "n"))
    return each.select("user_id", "event_type", "n", P.share(C("h"), C("event_type")).alias("share"), P.is_known(C("h"), C("event_type")).alias("is_known"))


# ---------------------------------------------------------------- windows

@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 40")
def latest_n_per_contact(spark, sf_dir):
    views = T(spark, sf_dir, "events").select(F.lit(1).alias("account_id"), C("user_id").cast("string").alias("canonical_email"), C("ts").alias("received_at"), C("event_id").alias("message_id"), F.array().cast("array<string>").alias("labels"), "user_id", "event_id")
    return P.usable(views, newest=40).select("user_id", "event_id")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS i FROM pages)
SELECT page_id, substr(h, 1, 2) AS code, arg_min(h, i) AS href, min(i)::INTEGER AS position FROM l GROUP BY page_id, substr(h, 1, 2)""")
def first_link_per_code(spark, sf_dir):
    found = T(spark, sf_dir, "pages").select("page_id", F.posexplode(page("html")["links"]["href"]).alias("i", "h"))
    return found.groupBy("page_id", F.substring("h", 1, 2).alias("code")).agg(F.min_by("h", "i").alias("href"), F.min("i").alias("position"))


@query("SELECT source AS contact, min(doc_id) AS representative, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def representative_per_contact(spark, sf_dir):
    return T(spark, sf_dir, "documents").groupBy(C("source").alias("contact")).agg(F.min("doc_id").alias("representative"), F.min_by("lang", "doc_id").alias("lang"))


@query("SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS watermark FROM events")
def watermark_advance(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T(spark, sf_dir, "events").select("user_id", "event_id", F.max("event_id").over(order).alias("watermark"))


@query("SELECT conv_id, max(turn) AS hop, arg_max(role, turn) AS from_host FROM conversations GROUP BY conv_id")
def last_hop_scalar(spark, sf_dir):
    return T(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("hop"), F.max_by("role", "turn").alias("from_host"))


@query("SELECT conv_id, turn, role, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same_as_before FROM conversations")
def mid_thread_change(spark, sf_dir):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return T(spark, sf_dir, "conversations").select("conv_id", "turn", "role", (C("role") == F.lag("role").over(order)).alias("same_as_before"))


# ---------------------------------------------------------------- sync, sets and DML

_CDC = """WITH c AS (SELECT event_id AS seq, user_id AS id, CASE event_type WHEN 'signup' THEN 'added' WHEN 'error' THEN 'deleted' ELSE 'labels' END AS kind, event_type AS label FROM events),
a AS (SELECT id, max(CASE WHEN kind = 'deleted' THEN 1 ELSE 0 END) AS deleted, max(CASE WHEN kind = 'added' THEN 1 ELSE 0 END) AS added, arg_max(label, seq) FILTER (kind = 'labels') AS label FROM c GROUP BY id)
SELECT id, CASE WHEN deleted = 1 THEN 'delete' WHEN added = 1 THEN 'insert' ELSE 'relabel' END AS action, label FROM a"""


@query(_CDC)
def cdc_apply(spark, sf_dir):
    kind = F.when(C("event_type") == "signup", "added").when(C("event_type") == "error", "deleted").otherwise("labels")
    changes = T(spark, sf_dir, "events").select(C("event_id").alias("seq"), C("user_id").alias("gmail_id"), kind.alias("kind"), C("event_type").alias("label_ids"))
    return S.net_changes(changes).select(C("gmail_id").alias("id"), "action", C("label_ids").alias("label"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def pending_antijoin(spark, sf_dir):
    return T(spark, sf_dir, "documents").join(T(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_known_ids(spark, sf_dir):
    return T(spark, sf_dir, "documents").join(T(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


@query("""WITH o AS (SELECT source, list(DISTINCT lang) AS l FROM documents WHERE doc_id % 2 = 0 GROUP BY source), n AS (SELECT source, list(DISTINCT lang) AS l FROM documents WHERE doc_id % 2 = 1 GROUP BY source)
SELECT n.source, array_to_string(list_sort(list_filter(n.l, lambda x: NOT list_contains(coalesce(o.l, []), x))), ',') AS unseen FROM n LEFT JOIN o ON n.source = o.source""")
def unseen_link_orgs(spark, sf_dir):
    half = lambda k: T(spark, sf_dir, "documents").where(C("doc_id") % 2 == k).groupBy("source").agg(F.collect_set("lang").alias(f"l{k}"))
    both = half(1).join(half(0), "source", "left")
    return both.select("source", F.array_join(F.array_sort(F.array_except("l1", F.coalesce("l0", F.array().cast("array<string>")))), ",").alias("unseen"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer UNION ALL SELECT c_custkey + 100000000, 1.0 FROM customer WHERE c_custkey % 5 = 0""")
def upsert_merge(spark, sf_dir):
    old = T(spark, sf_dir, "customer").select("c_custkey", C("c_acctbal").alias("balance"))
    fresh = old.where("c_custkey % 5 = 0")
    new = fresh.withColumn("balance", C("balance") + 1).union(fresh.select((C("c_custkey") + 100000000), F.lit(1.0)))
    return S.upsert(old, new, ["c_custkey"])


# ---------------------------------------------------------------- redaction, prompts, attachments, JSON, dates

@query(r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9_.+-]+@([A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,})', '[USER]@\1', 'g'), '\b[0-9]{6,}\b', '[NUMBER]', 'g') AS redacted FROM documents""")
def redact_simple(spark, sf_dir):
    masked = F.regexp_replace("text", r"[A-Za-z0-9_.+-]+@([A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,})", "[USER]@$1")
    return T(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(masked, r"\b[0-9]{6,}\b", "[NUMBER]").alias("redacted"))


@query()
def redact_full(spark, sf_dir):
    r = T(spark, sf_dir, "documents").select("doc_id", redaction.redacted("text").alias("r"))
    return r.select("doc_id", F.sha2("r", 256).alias("sha"), F.length("r").alias("chars"), F.regexp_count("r", F.lit(r"\[(USER|NUMBER|PHONE|IBAN|ACCOUNT|CARD-NUMBER|WALLET)\]")).alias("masked"))


@query("SELECT doc_id, sha256('p' || chr(0) || 'm' || chr(0) || '<subject>' || source || '</subject>' || chr(10) || '<body>' || substr(text, 1, 6000) || '</body>') AS prompt_sha256 FROM documents")
def prompt_hash(spark, sf_dir):
    text = F.concat(F.lit("p\0m\0<subject>"), "source", F.lit("</subject>\n<body>"), F.substring("text", 1, 6000), F.lit("</body>"))
    return T(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("prompt_sha256"))


@query("SELECT conv_id, substr(sha256(string_agg(lower(role), '|' ORDER BY turn)), 1, 32) AS order_hash FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def header_order_hash(spark, sf_dir):
    rows = T(spark, sf_dir, "conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", order_hash(C("r.role")).alias("order_hash"))


@query("""SELECT l_returnflag AS intent, count(*) AS calls, sum(l_partkey)::BIGINT AS input_tokens, sum(l_suppkey)::BIGINT AS output_tokens, (sum(l_partkey)::BIGINT * 5.0::DOUBLE + sum(l_suppkey)::BIGINT * 25.0::DOUBLE) / 1e6::DOUBLE AS cost FROM lineitem GROUP BY l_returnflag""")
def classifier_usage(spark, sf_dir):
    answers = T(spark, sf_dir, "lineitem").select(C("l_returnflag").alias("intent"), C("l_partkey").alias("input_tokens"), C("l_suppkey").alias("output_tokens"))
    return reports.usage(answers, "intent")


_EXTS = "['pdf','pdf.exe','zip','docm','html','jpg.js','one','txt','iso','xls']"
_FILE = f"replace(p_name, ' ', '_') || '.' || {_EXTS}[(p_partkey % 10)::INTEGER + 1]"
_EXT = "list_last(string_split({f}, '.'))"
_CAT = "CASE " + " ".join(f"WHEN {{e}} IN ({D.sql_list(v)}) THEN '{k}'" for k, v in EXTENSIONS.items()) + " END"


@query(f"""WITH f AS (SELECT p_partkey, {_FILE} AS f FROM part), e AS (SELECT p_partkey, f, string_split(f, '.')[-1] AS e, string_split(f, '.')[-2] AS d, len(string_split(f, '.')) AS n FROM f)
SELECT p_partkey, e AS ext, {_CAT.format(e='e')} AS category, n > 2 AND d IN ('pdf', 'jpg') AND e IN ('exe', 'js') AS is_double, e = 'pdf' AND p_partkey % 20 = 0 AS is_mismatch FROM e""")
def attachment_classes(spark, sf_dir):
    exts = F.array(*map(F.lit, ["pdf", "pdf.exe", "zip", "docm", "html", "jpg.js", "one", "txt", "iso", "xls"]))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.get(exts, (C("p_partkey") % 10).cast("int")))
    rows = T(spark, sf_dir, "part").select("p_partkey", name.alias("f"), F.when(C("p_partkey") % 20 == 0, "text/html").otherwise("").alias("t"))
    mismatch = N.type_mismatch(C("f"), C("t")).isNotNull() & (N.extension(C("f")) == "pdf")
    return rows.select("p_partkey", N.extension(C("f")).alias("ext"), N.category(N.extension(C("f"))).alias("category"), N.double_extension(C("f")).isNotNull().alias("is_double"), mismatch.alias("is_mismatch"))


@query("SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events")
def json_extract_events(spark, sf_dir):
    keys = F.json_object_keys("props")
    return T(spark, sf_dir, "events").select("event_id", F.expr("get_json_object(props, concat('$.', json_object_keys(props)[0]))").alias("first_value"), F.array_join(F.array_sort(keys), ",").alias("keys"))


@query("""WITH a AS (SELECT o_orderkey, floor((epoch_us(TIMESTAMP '1998-12-01') - epoch_us(o_orderdate)) / 86400000000.0)::BIGINT AS age_days FROM orders)
SELECT o_orderkey, age_days, CASE WHEN age_days <= 7 THEN 0.72 WHEN age_days <= 30 THEN 0.62 WHEN age_days <= 60 THEN 0.40 END::DOUBLE AS weight FROM a""")
def domain_age(spark, sf_dir):
    age = F.floor((F.unix_micros(F.lit("1998-12-01").cast("timestamp")) - F.unix_micros(C("o_orderdate").cast("timestamp"))) / 86_400_000_000)
    rows = T(spark, sf_dir, "orders").select("o_orderkey", age.cast("long").alias("age_days"))
    return rows.withColumn("weight", F.when(C("age_days") <= 7, 0.72).when(C("age_days") <= 30, 0.62).when(C("age_days") <= 60, 0.40))


@query("""SELECT o_orderkey AS domain FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN date_diff('day', o_orderdate::DATE, DATE '1998-08-10') >= 7 WHEN o_orderkey % 3 = 0 THEN false
 ELSE date_diff('day', o_orderdate::DATE, DATE '1998-08-10') >= 30 END UNION ALL SELECT o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 10 = 0""")
def intel_due(spark, sf_dir):
    o = T(spark, sf_dir, "orders")
    intel = o.select(C("o_orderkey").alias("domain"), C("o_orderdate").alias("checked_at"), F.when(C("o_orderstatus") == "F", "timeout").alias("error"), F.when(C("o_orderkey") % 3 != 0, C("o_orderdate")).alias("created_at"))
    domains = o.select(C("o_orderkey").alias("domain")).union(o.where("o_orderkey % 10 = 0").select(C("o_orderkey") + 1000000000))
    return S.stale(intel, domains, "1998-08-10")


@query("SELECT user_id AS account_id, event_id::VARCHAR AS gmail_id FROM events WHERE event_id % 2 = 1 AND ts >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY")
def offset_recovery(spark, sf_dir):
    listing = T(spark, sf_dir, "events").select(C("user_id").alias("account_id"), C("event_id").cast("string").alias("gmail_id"), C("ts").alias("received_at"), "event_id")
    now = listing.agg(F.max("received_at")).first()[0]
    return S.recovered(listing.where("event_id % 2 = 0"), listing, now, days=5).select("account_id", "gmail_id")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS contacts FROM events GROUP BY event_type")
def streaming_ingest(spark, sf_dir):
    from ..streaming.sync import drained

    log = drained(spark, f"{sf_dir}/events.parquet", T(spark, sf_dir, "events").schema)
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("contacts"))


def page_verdicts(spark, sf_dir) -> DataFrame:
    """Pages judged by their own URL as a link: the smallest whole path from table to tiers."""
    rows = T(spark, sf_dir, "pages").select(C("page_id").alias("message_id"), L.dissect(C("url")).alias("link"))
    none = F.lit(None).cast("map<string, struct<trick: string, known: boolean, near: struct<known: string, kind: string, confidence: double>, brand: string>>")
    rows = rows.withColumn("facts", none)
    found = F.array_compact(F.array(*[F.when(when, what.cast(FI.FINDING)) for _, when, what in R.link_rules(C("link"), C("facts"), F.lit(False), F.lit(False))]))
    return FI.with_verdict(rows.select("message_id", "link", found.alias("findings")))


@query()
def page_link_verdicts(spark, sf_dir):
    return page_verdicts(spark, sf_dir).select("message_id", C("link.host").alias("host"), "score", "tier", F.size("findings").alias("n_findings"))


assert set(RELIEF) == set(SEVERITIES)
