"""URL filters: pattern rules found by their rarest literal token.

A rule is a host with a path prefix (``example.com/en/`` fits that host and its subdomains), or
a pattern over host and path, in which ``*`` stands for anything and ``^`` for an end or any
character but letters and digits. Every address that a rule fits holds the rule's literal
tokens, whole runs of letters and digits. Each rule is indexed by that one of its tokens which
is rarest among the addresses; the tokens of an address fetch candidate rules, and only those
run their regular expression. A rule without a whole token is fetched by every address.

Rules are a table, of any size: what they run and what they are found by is made from their text by DataFrame
functions, as everything here is. Addresses are judged once per distinct host and path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioseek.llm.joins import lookup
from folioseek.plans.sizing import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: What a ``^`` in a pattern stands for.
EDGE = "(?:[^A-Za-z0-9]|^|$)"


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (action, kind, rule) with their Java regular expression over host and path, and their tokens.

    ``kind`` is host or pattern. Tokens are the runs of letters and digits, lower-cased, that every fitting address
    has as whole runs: in a pattern those with something other than ``*`` on both sides, in a host rule the
    first one too. A rule without any has the empty token. Rules with a null are left out, repeats count once.
    """
    text, is_host = F.col("rule"), F.col("kind") == "host"
    with_path = F.when(F.instr("rule", "/") > 0, text).otherwise(F.concat(text, F.lit("/")))
    plain = F.regexp_replace(with_path, "([^A-Za-z0-9])", r"\\$1")
    edges = F.translate(F.regexp_replace(text, "([^A-Za-z0-9*^])", r"\\$1"), "^", "\x01")
    pattern = F.replace(F.replace(edges, F.lit("*"), F.lit(".*")), F.lit("\x01"), F.lit(EDGE))
    regex = F.when(is_host, F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), plain)).otherwise(F.concat(F.lit("(?s)"), pattern))
    lower = F.translate(F.when(is_host, with_path).otherwise(text), UPPER, LOWER)
    whole = F.when(is_host, F.regexp_extract_all(lower, F.lit("(?<![a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)).otherwise(
        F.regexp_extract_all(lower, F.lit("(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])"), 1)
    )
    tokens = F.array_sort(F.array_distinct(whole))
    return (
        rules.select("action", "kind", "rule").where("action is not null and kind is not null and rule is not null").distinct()
        .withColumns({"regex": regex, "tokens": F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("")))})
    )


def host(url: Column | str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column | str) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1)


def _after(url: Column | str) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def candidates(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct places (host, path) with every compiled rule that one of their tokens fetches.

    Each rule stands under one token, the rarest of its own among the places, so it is fetched once by a place.
    The rules of a token are rows of their own, however many share it.
    """
    address = F.translate(F.concat("host", "path"), UPPER, LOWER)
    runs = F.regexp_extract_all(address, F.lit("([a-z0-9]+)"), 1)
    tokens = places.withColumn("token", F.explode(F.array_distinct(F.concat(runs, F.array(F.lit(""))))))
    held = rules.withColumn("token", F.explode("tokens"))
    wanted = held.select("token").distinct()
    frequency = lookup(tokens.select("token"), wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        held.join(frequency, "token", "left")
        .groupBy("rule", "kind", "action", "regex")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("t"))
    )
    index = materialize(rarest.select(F.col("t.token").alias("token"), "rule", "kind", "action", "regex"), "rule_index")
    return lookup(tokens, index, "token", "inner").drop("token")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    ``rules`` are a table (action, kind, rule), see ``compiled``.

    The longest fitting host rule wins and is named in ``rule`` (of equally long ones the last
    in text order). Without one, ``rule`` is null and the longest fitting pattern decides, with
    ``default`` where none fits. A null url, or one without ``://``, has empty host and path.
    One row comes out for each that goes in.
    """
    pages = pages.withColumns({"host": host(url), "path": path(url)})
    fetched = candidates(pages.select("host", "path").distinct(), compiled(rules))
    fitting = (
        fetched.where(F.regexp_like(F.concat("host", "path"), F.col("regex")))
        .groupBy("host", "path")
        .agg(F.max(F.struct(
            (F.col("kind") == "host").alias("named"), F.length("rule").alias("size"), "rule", "action",
        )).alias("best"))
    )
    return pages.join(fitting, ["host", "path"], "left").select(
        *[c for c in pages.columns if c not in ("rule", "verdict")],
        F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
