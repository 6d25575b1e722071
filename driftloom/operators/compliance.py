"""Crawl compliance: postures, legal manifests, robots rules, response blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import urls
from driftloom.functions.let import let
from driftloom.operators.once import with_once
from driftloom.operators.sized import join_small

# Fixed vocabulary.
STRICT, ADVERSARIAL = "strict_compliance", "adversarial_commercial"


def response_blocked(status: Column, posture: Column) -> Column:
    """Under the strict posture any 4xx but 404 is a stop."""
    stop = status.isin(403, 429) | (status.between(400, 499) & (status != 404))
    return F.coalesce((posture == STRICT) & stop, F.lit(False))


def domain_suffixes(domain: Column) -> Column:
    """The domain and every parent: ``a.b.c`` gives a.b.c, b.c, c."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def valid_manifest_domains(domains: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """Domains covered by a signed, unexpired manifest that names them or a parent domain.

    The suffix condition becomes an equi-join on the few suffixes of each domain.
    """
    names = (
        manifests.where(F.col("signature_ok") & (now <= F.col("expiration_date")))
        .select(F.explode("authorized_domains").alias("_suffix"))
        .distinct()
    )
    return (
        domains.select("domain")
        .distinct()
        .withColumn("_suffix", F.explode_outer(domain_suffixes(F.col("domain"))))
        .join(names, "_suffix", "left_semi")
        .select("domain")
        .distinct()
    )


def effective_posture(domains: DataFrame, postures: DataFrame, manifests: DataFrame, now: Column) -> DataFrame:
    """Posture in force per distinct domain: strict unless declared otherwise and covered."""
    declared = (
        domains.select("domain").distinct()
        .join(postures.select("domain", F.col("posture").alias("declared")), "domain", "left")
        .withColumn("declared", F.coalesce("declared", F.lit(STRICT)))
    )
    covered = valid_manifest_domains(domains, manifests, now).withColumn("_covered", F.lit(True))
    bare = (F.col("declared") == ADVERSARIAL) & F.col("_covered").isNull()
    return declared.join(covered, "domain", "left").select(
        "domain", "declared", F.when(bare, F.lit(STRICT)).otherwise(F.col("declared")).alias("posture")
    )


def robots_index(rules: DataFrame, agent: str = "*") -> DataFrame:
    """The rules in force per host, one row each: those of the agent's group, or of ``*`` where it has none.

    ``rules``: host, user_agent, allow, path, crawl_delay. A rule's path is cut at its wildcards into ``pieces``; the first one is the
    ``literal`` that every matching path starts with. ``anchored``: a ``$`` ends it. A group without a path that can match (an empty one
    never does) keeps one row without pieces, for its crawl delay.
    """
    mine = F.lower("user_agent") == agent.lower()
    named = rules.where(mine).select("host").distinct().withColumn("_named", F.lit(True))
    known = rules.where(mine | (F.col("user_agent") == "*")).join(named, "host", "left")
    known = known.where(mine == F.coalesce("_named", F.lit(False))) if agent != "*" else known.where(mine)
    delays = known.groupBy("host").agg(F.max("crawl_delay").alias("crawl_delay"))
    anchored = F.endswith("path", F.lit("$"))
    body = F.when(anchored, F.expr("substring(path, 1, length(path) - 1)")).otherwise(F.col("path"))
    paths = known.where("path != ''").groupBy("host", "path").agg(F.bool_or("allow").alias("allow")).select(
        "host", "path", "allow", anchored.alias("anchored"), F.split(body, r"\*", -1).alias("pieces")
    )
    return delays.join(paths.withColumn("literal", F.col("pieces")[0]), "host", "left")


def robots_match(path: Column, pieces: Column, anchored: Column) -> Column:
    """Whether a path starts with the first piece and holds the others in order, the last one at its end if anchored.

    Taking each piece at its first place leaves the most room for the rest, so no other choice need be tried.
    """

    def ends(p: Column) -> Column:
        """Where the pieces between the first and the last end; null if one is missing."""
        inner = F.when(F.size(p) > 2, F.slice(p, F.lit(2), F.size(p) - 2)).otherwise(F.array().cast("array<string>"))

        def after(at: Column, piece: Column) -> Column:
            found = F.call_function("locate", piece, path, at + 1)
            return F.when(piece == "", at).otherwise(let(found, lambda n: F.when(n > 0, n + F.length(piece) - 1)))

        return F.aggregate(inner, F.length(p[0]), after)

    def last(p: Column) -> Column:
        tail = F.element_at(p, -1)
        whole = F.when(anchored, path == p[0]).otherwise(F.lit(True))

        def fits(at: Column) -> Column:
            loose = F.call_function("locate", tail, path, at + 1) > 0
            right = F.when(anchored, F.endswith(path, tail) & (F.length(path) - F.length(tail) >= at)).otherwise((tail == "") | loose)
            return at.isNotNull() & right

        return F.startswith(path, p[0]) & F.when(F.size(p) == 1, whole).otherwise(let(ends(p), fits))

    return F.coalesce(let(pieces, last), F.lit(False))


def robots_verdicts(paths: DataFrame, index: DataFrame) -> DataFrame:
    """(host, path, rule_allows) of the paths that a rule matches: the longest one decides, allow on a tie.

    A path looks up its prefixes, only those as long as some literal of its host, in the rules listed under (host, literal). So a path
    meets the rules that share its beginning, not all of its host; a busy host is spread by path and prefix, and no pattern is compiled.
    """
    rules = index.where("pieces is not null").select("host", "literal", F.length("path").alias("_length"), "allow", "anchored", "pieces")
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("literal")).alias("_lengths"))
    wide = join_small(paths.select("host", "path").distinct(), lengths, ["host"])
    own = F.filter("_lengths", lambda n: n <= F.length("path"))
    prefixes = wide.select("host", "path", F.explode_outer(own).alias("_n"))
    keyed = with_once(prefixes, "literal", F.expr("substring(path, 1, _n)")).drop("_n")
    met = join_small(keyed, rules, ["host", "literal"])
    hit = met.where(robots_match(F.col("path"), F.col("pieces"), F.col("anchored")))
    return hit.groupBy("host", "path").agg(F.max(F.struct("_length", "allow")).alias("_best")).select("host", "path", F.col("_best.allow").alias("rule_allows"))


def robots_filter(urls_df: DataFrame, index: DataFrame, fetches: DataFrame) -> DataFrame:
    """Adds ``robots_allowed`` and ``crawl_delay``. ``index``: of ``robots_index``.

    ``fetches``: host, status of the robots file (null for a failed fetch). A failed fetch, a
    5xx or an unknown host disallows, a 4xx other than 429 allows, else the rules decide.
    """
    known = fetches.select("host", "status", F.lit(True).alias("_known"))
    delays = index.groupBy("host").agg(F.max("crawl_delay").alias("crawl_delay"))
    rows = with_once(urls_df, "host", urls.netloc_of(F.col("url")))
    rows = with_once(rows, "path", urls.path_of(F.col("url")))
    rows = join_small(join_small(rows, known, ["host"], "left"), delays, ["host"], "left")
    rows = rows.join(robots_verdicts(rows, index), ["host", "path"], "left")
    status = F.col("status")
    allowed = (
        F.when(F.col("_known").isNull() | status.isNull() | (status >= 500), F.lit(False))
        .when(status.between(400, 499) & (status != 429), F.lit(True))
        .otherwise(F.coalesce("rule_allows", F.lit(True)))
    )
    return rows.withColumn("robots_allowed", allowed).select(*urls_df.columns, "robots_allowed", "crawl_delay")


def audit_compliance(
    pages: DataFrame,
    postures: DataFrame,
    manifests: DataFrame,
    index: DataFrame,
    fetches: DataFrame,
    responses: DataFrame,
    now: Column,
) -> DataFrame:
    """One verdict and reason per URL. ``responses``: page_id, status."""
    posture = effective_posture(pages, postures, manifests, now)
    rows = robots_filter(pages.select("page_id", "url", "domain"), index, fetches)
    rows = rows.join(posture, "domain", "left").join(responses.select("page_id", "status"), "page_id", "left")
    reason = (
        F.when(~F.col("robots_allowed"), F.lit("robots_disallow"))
        .when(response_blocked(F.col("status"), F.col("posture")), F.lit("response_blocked"))
    )
    return rows.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())
