"""Services and the connections between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamgraph.functions.urls import join_route, request_url, route_matches, url_part


def ancestors(path):
    """All leading parts of a path, the shortest (``.``) first: what a prefix may equal."""
    parts = F.split(path, "/", -1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def longest_prefix(items: DataFrame, path: str, prefixes: DataFrame, prefix: str, keys: list[str] | None = None) -> DataFrame:
    """``items`` with the longest of ``prefixes`` that their path is or lies under; ``.`` is the shortest.

    Every item meets its own leading parts by equality, so no item is compared with every prefix.
    """
    keys = keys or []
    tagged = items.withColumn("_row", F.monotonically_increasing_id())
    laid = tagged.select("*", F.posexplode(ancestors(F.col(path))).alias("_depth", "_prefix"))
    other = prefixes.withColumnRenamed(prefix, "_prefix")
    met = laid.join(other, [*keys, "_prefix"])
    rank = F.row_number().over(Window.partitionBy("_row").orderBy(F.desc("_depth")))
    return met.withColumn("_n", rank).where("_n = 1").drop("_n", "_row", "_depth").withColumnRenamed("_prefix", prefix)


def connect_http(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Links of requests (request_id, service, method, base, address) to providers (provider_id, provider, method,
    origin, route): same origin, fitting method and route.

    Candidates meet by origin and number of segments. A request with one fit has a confidence of 0.85, with more 0.5.
    """
    url = request_url(F.col("base"), F.col("address"))
    origin = lambda u: F.lower(F.concat(url_part(u, "PROTOCOL"), F.lit("://"), url_part(u, "AUTHORITY")))
    size = lambda p: F.size(F.split(F.regexp_replace(p, "/$", ""), "/", -1))
    asked = requests.select("request_id", "service", F.col("method").alias("_m"), url.alias("_url")).where("_url is not null and _m is not null and _m <> '?'")
    asked = asked.withColumn("_path", F.coalesce(F.nullif(url_part("_url", "PATH"), F.lit("")), F.lit("/"))).withColumn("_origin", origin(F.col("_url")))
    route = F.concat(F.lit("/"), join_route(url_part("origin", "PATH"), F.col("route")))
    given = providers.where("route is not null and origin is not null").select("provider_id", "provider", F.col("method").alias("_pm"), route.alias("_route"), origin(F.col("origin")).alias("_origin"))
    met = asked.withColumn("_n", size(F.col("_path"))).join(given.withColumn("_n", size(F.col("_route"))), ["_origin", "_n"])
    met = met.where(((F.col("_pm") == "*") | (F.col("_pm") == F.col("_m"))) & route_matches("_route", "_path"))
    links = met.select("request_id", "service", "provider_id", "provider").distinct()
    return graded(links)


def connect_channels(senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """Links of senders (request_id, service, protocol, resource, address, channel_kind) to receivers (provider_id,
    provider, ...) of equal protocol, resource and address whose channel kinds do not differ."""
    key = ["protocol", "resource", "address"]
    a = senders.select("request_id", "service", *key, F.col("channel_kind").alias("_a"))
    b = receivers.select("provider_id", "provider", *key, F.col("channel_kind").alias("_b"))
    met = a.join(b, key).where("_a is null or _b is null or _a = _b")
    return graded(met.select("request_id", "service", "provider_id", "provider").distinct())


def graded(links: DataFrame) -> DataFrame:
    many = F.count("*").over(Window.partitionBy("request_id")) > 1
    return links.withColumn("confidence", F.when(many, 0.5).otherwise(0.85)).withColumn("evidence", F.when(many, "ambiguous candidate").otherwise("inferred from declarations"))


def readiness(sites: DataFrame, examples: int = 2, top: int | None = 100) -> DataFrame:
    """Requirements of connections: sites (service, kind, setting, status, place) by service, kind, setting and status.

    Missing ones come first, then dynamic, then configured; each with its number of sites and first examples.
    """
    found = sites.groupBy("service", "kind", "setting", "status").agg(F.count("*").alias("sites"), F.slice(F.array_sort(F.collect_set("place")), 1, examples).alias("examples"))
    order = F.array_position(F.array(F.lit("missing"), F.lit("dynamic"), F.lit("configured")), F.col("status"))
    return found if top is None else found.orderBy(order, "service", "setting", "kind").limit(top)


def status_counts(sites: DataFrame) -> DataFrame:
    """(service, missing, dynamic, configured)."""
    return sites.groupBy("service").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "dynamic", "configured")])


def cross_service_impact(calls: DataFrame, bridges: DataFrame, seeds: DataFrame, depth: int = 4, bridge_limit: int = 2) -> DataFrame:
    """(seed, node, bridges, distance): who is affected across services.

    calls: (src, dst) dependency steps within services, bridges: (src, dst) across them; at most ``bridge_limit`` of
    these on a path. A node counts once for each number of bridges it needs least.
    """
    from loamgraph.plans.storage import store

    step = calls.select("src", "dst", F.lit(0).alias("_b")).unionByName(bridges.select("src", "dst", F.lit(1).alias("_b"))).distinct()
    step = store(step.repartition("src"), "steps")
    frontier = store(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("bridges"), F.lit(0).alias("distance")).distinct(), "bridged")
    seen = frontier
    for d in range(1, depth + 1):
        new = frontier.join(step, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), (F.col("bridges") + F.col("_b")).alias("bridges"))
        new = new.where(F.col("bridges") <= bridge_limit).distinct().join(seen.select("seed", "node", "bridges"), ["seed", "node", "bridges"], "left_anti")
        frontier = store(new.withColumn("distance", F.lit(d)), "bridged")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    best = seen.groupBy("seed", "node").agg(F.min(F.struct("distance", "bridges")).alias("b"))
    return best.select("seed", "node", "b.bridges", "b.distance")


def compose(endpoints: DataFrame, services: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The connections between services, and the requests that none serves.

    endpoints: (root, file, id, protocol, direction, method, address, setting); services: (root, path, service, origin);
    settings: (service, setting, url). An endpoint belongs to the service with the longest path that holds its file; a
    request that begins with a setting takes its url. Connections: (request_id, service, provider_id, provider,
    confidence, evidence, protocol); what is left: (request_id, service, address).
    """
    prefixes = services.select("root", F.col("path").alias("prefix"), "service", "origin")
    placed = longest_prefix(endpoints, "file", prefixes, "prefix", ["root"])
    known = settings.select("service", "setting", F.col("url").alias("_base"))
    asked = placed.where("direction = 'request'").join(known, ["service", "setting"], "left")
    requests = asked.select(F.col("id").alias("request_id"), "service", "method", F.col("_base").alias("base"), "address")
    providers = placed.where("protocol = 'http' and direction = 'provide'").select(F.col("id").alias("provider_id"), F.col("service").alias("provider"), "method", "origin", F.col("address").alias("route"))
    web = connect_http(requests, providers).withColumn("protocol", F.lit("http"))
    side = lambda way, names: placed.where((F.col("protocol") != "http") & (F.col("direction") == way)).select(F.col("id").alias(names[0]), F.col("service").alias(names[1]), "protocol", F.lit("").alias("resource"), "address", F.lit(None).cast("string").alias("channel_kind"))
    sent, received = side("publish", ("request_id", "service")), side("subscribe", ("provider_id", "provider"))
    channels = connect_channels(sent, received).join(sent.select("request_id", "protocol"), "request_id")
    links = web.unionByName(channels.select(web.columns))
    left = requests.join(web.select("request_id").distinct(), "request_id", "left_anti").select("request_id", "service", "address")
    return links, left


def service_map(links: DataFrame) -> DataFrame:
    """(service, provider, protocol, links): how services depend on one another."""
    return links.where("service <> provider").groupBy("service", "provider", "protocol").agg(F.count("*").alias("links"))
