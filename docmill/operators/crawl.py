"""Crawled pages: which links to follow, what they reach, where files go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as X
from docmill.operators import ingest, names

# What addresses of each archive must and must not contain.
BULLETINS_NOT = ("risoluzioni", "interpello", "provvedimenti", "software", "specifiche-tecniche", "/modelli", "codici-tributo", "agenzia-comunica", "servizi", "documentazione-economica")
PROVISIONS = ("altri-provvedimenti-non-soggetti", "provvedimenti-non-soggetti", "non-soggetti-a-pubblicita", "non-soggetti-a-pubblicit", "provvedimenti-del-direttore-non-soggetti")
PROVISION_YEARS = r"provvedimenti-20\d{2}|archivio-20\d{2}-provvedimenti"
PROVISIONS_NOT = ("circolari", "risoluzioni", "interpello", "software", "specifiche-tecniche", "studi-di-settore", "scadenzario", "ufficio-studi", "osservatorio", "territorio", "soggetti-a-pubblicita")
RULINGS = ("interpelli", "interpello", "principi-di-diritto", "consulenza-giuridica", "nuovi-investimenti")
RULINGS_NOT = ("risoluzioni", "circolari", "provvedimenti-del-direttore", "/provvedimenti/", "software", "specifiche-tecniche", "/modelli", "codici-tributo", "agenzia-comunica", "servizi", "documentazione-economica", "scadenzario", "territorio", "newslett")
RULINGS_STRONG = ("archivio-interpelli", "principi-di-diritto", "consulenza-giuridica")
NOTARY_NOT = ("circolari", "risoluzioni", "interpello", "/modelli", "servizi")


def has_any(text: Column, parts: tuple[str, ...]) -> Column:
    """One pattern for all parts, so that the text is read once."""
    return text.rlike("|".join(p.replace(".", r"\.") for p in parts))


def inside(url: Column, base: str) -> Column:
    return url.startswith(base)


def followed(url: Column, base: str, rule) -> Column:
    """Links that stay on the site and meet an archive's rule."""
    return inside(url, base) & rule(url)


def follow_bulletin(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("circolari") & ~has_any(low, BULLETINS_NOT)


def follow_resolution(url: Column) -> Column:
    return F.lower(url).contains("risoluzioni")


def follow_provision(url: Column) -> Column:
    low = F.lower(url)
    dated = low.contains("provvedimenti") & (low.rlike(PROVISION_YEARS) | (has_any(low, X.MONTHS) & low.contains("20")))
    return (has_any(low, PROVISIONS) | dated) & (low.contains("non-soggetti") | ~has_any(low, PROVISIONS_NOT))


def follow_ruling(url: Column) -> Column:
    low = F.lower(url)
    return has_any(low, RULINGS) & (has_any(low, RULINGS_STRONG) | ~has_any(low, RULINGS_NOT))


def follow_notary(url: Column) -> Column:
    low = F.lower(url)
    return has_any(low, ("provvedimenti", *X.MONTHS)) & ~has_any(low, NOTARY_NOT)


def is_document(url: Column) -> Column:
    return F.lower(X.url_path(url)).endswith(".pdf") | url.contains("/sites/default/files/")


def is_category(path: Column) -> Column:
    """A path whose last part is a number and a slug."""
    return path.rlike(r"^/[^?#]*/?\d+-[a-z0-9-]+/?$")


def child_of(path: Column, category: Column) -> Column:
    return path.startswith(category) & (F.regexp_replace(path, "/+$", "") != F.regexp_replace(category, "/+$", ""))


def section_choice(wanted: DataFrame, sections: DataFrame, name: str = "name", pos: str = "pos") -> DataFrame:
    """For each wanted name its section: the exact one, else the first whose name contains it or is contained, case apart."""
    pairs = names.containment(wanted, sections, name, name)
    best = F.min_by(name, pos).alias("section")
    exact = sections.groupBy(F.col(name).alias("wanted")).agg(F.min_by(name, pos).alias("exact"))
    # Of sections with one name, case apart, the first stands for all.
    first = sections.where(F.col(name).isNotNull()).groupBy(F.lower(name).alias("r")).agg(F.min(F.struct(pos, name)).alias("s")).select("r", F.col(f"s.{pos}").alias(pos), F.col(f"s.{name}").alias(name))
    near = pairs.join(first, "r").groupBy("l").agg(best)
    asked = wanted.select(F.col(name).alias("wanted")).distinct()
    found = asked.join(exact, "wanted", "left").join(near, F.lower("wanted") == F.col("l"), "left")
    return found.select("wanted", F.coalesce("exact", "section").alias("section"))


def closure(edges: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, depth) of everything that roots (node) reach over edges (src, dst), cycles included.

    A step joins the newest nodes with the edges and leaves out those visited, and is written to the
    shared folder; it ends when a step finds nothing, or after `most` steps.
    """
    from docmill.sources.tables import written

    found = roots.select("node").distinct().withColumn("depth", F.lit(0))
    newest = found
    for depth in range(1, most + 1):
        step = newest.join(edges, newest["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(found, "node", "left_anti")
        newest = written(step.withColumn("depth", F.lit(depth)), "crawl")
        if newest.isEmpty():
            return found
        found = found.unionByName(newest)
        if depth % 16 == 0:  # one table in place of many, so that plans stay short
            found = written(found, "crawl")
    raise RuntimeError(f"more nodes are reached after {most} steps")


def ranked_pages(edges: DataFrame, starts: DataFrame, most: int = 64) -> DataFrame:
    """(lane, page, pos): pages in the order in which following `next` from each lane's start meets them.

    edges: page, next (one row a page; of several the smallest next counts).  starts: lane, page.  Jumps double: a round joins all
    pages known so far with where 2^k steps lead, so that a chain of n pages takes log n rounds; a round that finds
    no page anew is the last, which ends cycles too, at the page first met.
    """
    from docmill.sources.tables import written

    jump = edges.where("page IS NOT NULL AND next IS NOT NULL").groupBy("page").agg(F.min("next").alias("next"))
    known = written(starts.where("page IS NOT NULL").groupBy("lane", "page").agg(F.lit(0).cast("long").alias("pos")), "ranks")
    n = known.count()
    for k in range(most):
        further = known.join(jump, "page").select("lane", F.col("next").alias("page"), (F.col("pos") + (1 << k)).alias("pos"))
        known = written(known.unionByName(further).groupBy("lane", "page").agg(F.min("pos").alias("pos")), "ranks")
        before, n = n, known.count()
        if n == before:
            return known
        there = jump.select(F.col("page").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(there, "next").select("page", F.col("then").alias("next")), "jumps")
    raise RuntimeError(f"more pages are reached after 2^{most} steps")


def category_crawl(edges: DataFrame, starts: DataFrame, items: DataFrame, stored: DataFrame, idle: int = 2) -> tuple[DataFrame, DataFrame]:
    """What a paged crawl of each lane takes, and its counters.

    items: page, item.  Pages are walked in order; a page's new items are those that neither stored (item) nor an
    earlier page of the lane has; the walk ends behind the first `idle` pages in a row without a new one.  Returns
    (lane, item, page, pos) of the new items of the pages walked, and (lane, pages, seen, new, repeated, known).
    """
    pages = ranked_pages(edges, starts)
    on = pages.join(items.select("page", "item").distinct(), "page")
    have = stored.select("item").distinct().withColumn("known", F.lit(True))
    first = on.groupBy("lane", "item").agg(F.min_by(F.struct("pos", "page"), F.struct("pos", "page")).alias("f")).join(have, "item", "left")
    first = first.select("lane", "item", F.col("f.pos").alias("pos"), F.col("f.page").alias("page"), F.coalesce("known", F.lit(False)).alias("known"))
    fresh = first.where("NOT known").groupBy("lane", "pos").agg(F.count("*").alias("n_new"))
    counted = pages.join(fresh, ["lane", "pos"], "left").select("lane", "page", "pos", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    walked = ingest.stop_after_idle(counted, "lane", "pos", idle=idle).select("lane", "page", "pos", "n_new")
    last = walked.groupBy("lane").agg(F.max("pos").alias("last"), F.count("*").alias("pages"), F.sum("n_new").alias("new"))
    inside = lambda df: df.join(last.select("lane", "last"), "lane").where("pos <= last").drop("last")
    seen = inside(on).groupBy("lane").agg(F.count("*").alias("seen"))
    old = inside(first).groupBy("lane").agg(F.count_if("known").alias("known_items"), F.count("*").alias("items"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    counters = last.join(seen, "lane", "left").join(old, "lane", "left").select("lane", "pages", n("seen").alias("seen"), "new", (n("seen") - n("items")).alias("repeated"), n("known_items").alias("known"))
    return inside(first.where("NOT known")).select("lane", "item", "page", "pos"), counters


def files_per_year(files: DataFrame, year: str = "year") -> DataFrame:
    """Files by year and in all; files without a year are left out."""
    counts = files.where(F.col(year).isNotNull()).rollup(year).agg(F.count("*").alias("n"))
    return counts.select(F.coalesce(year, F.lit("TOTAL")).alias("year"), "n")


def related(items: Column) -> Column:
    """Link texts of more than 5 characters; none is null."""
    long = F.filter(items, lambda t: F.length(t) > 5)
    return F.when(F.size(long) > 0, long)


def section_documents(items: DataFrame, page: str, pos: str, heading: str, link: str, first_of: str, all_of: str) -> DataFrame:
    """Links of a page in order, each under the last heading before it: the first of one section, all of another."""
    order = Window.partitionBy(page).orderBy(pos)
    under = items.withColumn("section", F.last(heading, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    links = under.where(F.col(link).isNotNull())
    first = links.where(F.col("section") == first_of).groupBy(page).agg(F.min_by(F.struct(pos, link, "section"), pos).alias("d")).select(page, "d.*")
    return first.unionByName(links.where(F.col("section") == all_of).select(page, pos, link, "section"))


def not_found(heading: Column) -> Column:
    return F.contains(F.lower(heading), F.lit("non trovata"))
