"""The thin queries of the operators that are DataFrame functions only, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioseek.llm import decontaminate, mixing, urls
from folioseek.llm.registry import query, read

#: Fixed rules of the query: action, then host and path.
HOST_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Patterns of the query for addresses that no rule above decides: each form with each word in place of W. The longest fits.
PATTERN_WORDS = ("casino", "poker", "bets", "betting", "viagra", "porn", "xxx", "adult", "warez", "ads", "track", "loan")
PATTERN_FORMS = (
    ("block", "^W^"), ("block", "^free^W^"), ("block", "^W^*^x^"), ("block", "^m.W^"), ("block", "^W^*^page^"),
    ("block", "*://*W*/login^"), ("block", "^blog^*^W^"), ("allow", "^W^*^help^"), ("allow", "^W^example.org^*^en^"),
    ("allow", "^www.*^W^*^fr^"),
)


def pattern_regex(rule: str) -> str:
    """The regular expression of a pattern, for the SQL."""
    kinds = {"*": ".*", "^": urls.EDGE}
    return "(?s)" + "".join(kinds.get(c) or (c if c.isalnum() else "\\" + c) for c in rule)


PATTERN_SQL = ", ".join(
    f"('{action}', '{form.replace('W', word)}', '{pattern_regex(form.replace('W', word))}')"
    for action, form in PATTERN_FORMS
    for word in PATTERN_WORDS
)

OP8_SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), named AS (
    SELECT *, CASE
        WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
        WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
        WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
        WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
    END AS rule
    FROM parts
), patterns(action, pattern, regex) AS (VALUES {PATTERN_SQL}
), best AS (
    SELECT place, arg_max(action, (length(pattern), pattern)) AS action
    FROM (SELECT DISTINCT host || path AS place FROM parts) JOIN patterns ON regexp_matches(place, regex) GROUP BY place
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    ELSE coalesce(action, 'allow') END AS verdict
FROM named LEFT JOIN best ON host || path = place
"""


def page_rules(spark: SparkSession) -> DataFrame:
    """The query's rules as a table: those of hosts, and every form of a pattern with every word."""

    def listed(values, i):
        return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))

    hosts = spark.range(len(HOST_RULES)).select(
        listed([a for a, _ in HOST_RULES], F.col("id")).alias("action"), F.lit("host").alias("kind"),
        listed([t for _, t in HOST_RULES], F.col("id")).alias("rule"),
    )
    words = len(PATTERN_WORDS)
    form, word = F.floor(F.col("id") / words), F.col("id") % words
    patterns = spark.range(words * len(PATTERN_FORMS)).select(
        listed([a for a, _ in PATTERN_FORMS], form).alias("action"), F.lit("pattern").alias("kind"),
        F.replace(listed([f for _, f in PATTERN_FORMS], form), F.lit("W"), listed(PATTERN_WORDS, word)).alias("rule"),
    )
    return hosts.union(patterns)


@query("op8_url_filter", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's address judged by host rules, else by the longest pattern that fits."""
    judged = urls.judge(read(spark, sf_dir, "pages", "page_id", "url"), page_rules(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = rf"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(
        translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item, least(len(w), 13) AS n, unnest([array_to_string(w[i : i + least(len(w), 13) - 1], ' ')
        for i in range(1, len(w) - least(len(w), 13) + 2)]) AS win
    FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT row, n, i AS place, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (
    SELECT row, place, p.n, item FROM places p JOIN windows USING (win) WHERE p.n = windows.n
), counted AS (
    SELECT row, count(DISTINCT hit_word) AS n_hit FROM (SELECT row, unnest(range(place, place + n)) AS hit_word FROM hits) GROUP BY row
), items AS (
    SELECT row, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
    FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN counted USING (row) LEFT JOIN items USING (row)
"""


@query("op9_decontamination", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside windows of benchmark items."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    judged = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return judged.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


#: Weights of the mixture: domains by number, and English twice any other language.
DOMAIN_WEIGHTS = (1, 2, 3, 4)
ENGLISH_WEIGHT = 2
MIX_SEED, MIX_EPOCHS, MIX_SHARE = 17, 4, 0.5


def with_domain(docs: DataFrame) -> DataFrame:
    """A domain for each source of the tables: its number modulo 4, or ``other``."""
    number = F.expr("try_cast(substring(source, 4) AS int)")
    return docs.withColumn("domain", F.coalesce(F.concat(F.lit("domain"), (number % 4).cast("string")), F.lit("other")))


def weights(spark: SparkSession) -> DataFrame:
    rows = [(f"domain{i}", None, w) for i, w in enumerate(DOMAIN_WEIGHTS)]
    rows += [(f"domain{i}", "en", ENGLISH_WEIGHT) for i in range(len(DOMAIN_WEIGHTS))]
    row = [
        F.struct(
            F.lit(d).alias("domain"), F.lit(lang).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
            F.lit(w).alias("weight"),
        )
        for d, lang, w in rows
    ]
    return spark.range(1).select(F.explode(F.array(*row)).alias("r")).select("r.*")


def _fill(name: str, above: str, own: list[str], weight: str) -> str:
    """SQL of one level: budgets of the children of every node."""
    keys = ", ".join(own)
    part = f"PARTITION BY {', '.join(own[:-1])}" if own[:-1] else ""
    join = " AND ".join(f"n.{c} = p.{c}" for c in own[:-1]) or "TRUE"
    return f"""
{name}_nodes AS (
    SELECT n.*, p.budget AS parent FROM (SELECT {keys}, {weight} AS w, sum(tokens) * {MIX_EPOCHS} AS cap FROM leaves GROUP BY {keys}) n
    JOIN {above} p ON {join}
), {name}_levels AS (
    SELECT *, row_number() OVER (o) AS rank,
        CAST(parent - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM {name}_nodes WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {keys})
), {name}_first AS (
    SELECT *, min(CASE WHEN NOT cap <= w * level THEN rank END) OVER ({part}) AS f FROM {name}_levels
), {name} AS (
    SELECT {keys}, CAST(CASE WHEN f IS NULL OR rank < f THEN cap
        ELSE least(cap, floor(w * max(CASE WHEN rank = f THEN level END) OVER ({part}) + 1e-6)) END AS BIGINT) AS budget
    FROM {name}_first
)"""


OP3_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        coalesce('domain' || CAST(TRY_CAST(substr(source, 4) AS INT) % 4 AS VARCHAR), 'other') AS domain,
        CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS n_tokens
    FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL
), root AS (SELECT least(CAST(floor(sum(tokens) * {MIX_SHARE}) AS BIGINT), sum(tokens) * {MIX_EPOCHS}) AS budget FROM leaves),
{_fill("domains", "root", ["domain"], "CASE domain " + " ".join(f"WHEN 'domain{i}' THEN {w}" for i, w in enumerate(DOMAIN_WEIGHTS)) + " ELSE 1 END")},
{_fill("langs", "domains", ["domain", "lang"], f"CASE WHEN domain <> 'other' AND lang = 'en' THEN {ENGLISH_WEIGHT} ELSE 1 END")},
{_fill("sources", "langs", ["domain", "lang", "source"], "1")},
plan AS (
    SELECT domain, lang, source, coalesce(budget // nullif(tokens, 0), 0) AS whole,
        budget - coalesce(budget // nullif(tokens, 0), 0) * tokens AS rest
    FROM leaves JOIN sources USING (domain, lang, source)
), last AS (
    SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
        ORDER BY md5(concat_ws(':', '{MIX_SEED}', CAST(whole + 1 AS VARCHAR), CAST(doc_id AS VARCHAR)))
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, epoch, n_tokens, n_tokens AS take_tokens
FROM (SELECT *, unnest(range(1, whole + 1)) AS epoch FROM last)
UNION ALL
SELECT doc_id, domain, lang, source, whole + 1 AS epoch, n_tokens, CAST(least(n_tokens, rest - before) AS BIGINT) AS take_tokens
FROM last WHERE before < rest
"""


@query("op3_source_mixing", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents to half their tokens, at most four times each."""
    docs = with_domain(read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    budget = F.floor(F.sum("tokens") * MIX_SHARE)
    mixed = mixing.mix(docs, weights(spark), budget, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select(
        "doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        "epoch", "n_tokens", "take_tokens",
    )
