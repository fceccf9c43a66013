"""Stored pages of a source-control catalog -> repositories, branches, pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findmill.functions.text import text_or_empty

REPO_PAGE = (
    "values array<struct<slug string, name string, language string, "
    "project struct<key string>, description string, mainbranch struct<name string>>>, next string"
)
BRANCH_PAGE = "values array<struct<name string, target struct<hash string, message string>>>, next string"
PR_PAGE = (
    "values array<struct<id long, title string, state string, "
    "source struct<branch struct<name string>, commit struct<hash string>>, destination struct<branch struct<name string>>, "
    "author struct<display_name string>, links struct<html struct<href string>>>>, next string"
)
PR_STATES = ("OPEN", "MERGED", "DECLINED", "SUPERSEDED")


def _values(pages: DataFrame, schema: str) -> tuple[DataFrame, list[str]]:
    keys = [c for c in pages.columns if c != "body"]
    doc = pages.select(*keys, F.from_json("body", schema).alias("doc"))
    return doc.select(*keys, F.explode("doc.values").alias("v")), keys


def catalog_repos(pages: DataFrame) -> DataFrame:
    rows, keys = _values(pages, REPO_PAGE)
    return rows.select(
        *keys,
        F.col("v.slug").alias("slug"),
        F.col("v.name").alias("name"),
        F.col("v.language").alias("language"),
        F.col("v.project.key").alias("project"),
        F.substring(text_or_empty("v.description"), 1, 200).alias("description"),
        F.coalesce(F.nullif("v.mainbranch.name", F.lit("")), F.lit("main")).alias("default_branch"),
    )


def catalog_branches(pages: DataFrame) -> DataFrame:
    rows, keys = _values(pages, BRANCH_PAGE)
    return rows.select(
        *keys,
        F.col("v.name").alias("name"),
        text_or_empty("v.target.hash").alias("hash"),
        F.substring(text_or_empty("v.target.message"), 1, 100).alias("message"),
    )


def catalog_pull_requests(pages: DataFrame, state: str = "OPEN") -> DataFrame:
    """An unknown wanted state does not filter."""
    rows, keys = _values(pages, PR_PAGE)
    wanted = state.upper()
    if wanted in PR_STATES:
        rows = rows.where(F.upper(text_or_empty("v.state")) == wanted)
    return rows.select(
        *keys,
        F.col("v.id").alias("id"),
        F.col("v.title").alias("title"),
        F.col("v.state").alias("state"),
        F.col("v.source.branch.name").alias("source"),
        F.col("v.destination.branch.name").alias("destination"),
        text_or_empty("v.author.display_name").alias("author"),
        F.col("v.links.html.href").alias("link"),
        text_or_empty("v.source.commit.hash").alias("commit"),
    )


def page_cursor(next_url: Column | str, base_url: str) -> Column:
    """Path and query to ask for next; null when there is no next page.

    The path is given below the API base; the query is kept as it is.
    """
    url = F.col(next_url) if isinstance(next_url, str) else next_url
    base = F.regexp_replace(F.coalesce(F.parse_url(F.lit(base_url), F.lit("PATH")), F.lit("")), "/+$", "")
    path = F.parse_url(url, F.lit("PATH"))
    query = F.parse_url(url, F.lit("QUERY"))
    below = F.when(
        (base != "") & path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 1, F.length(path))
    ).otherwise(path)
    cursor = F.when(F.coalesce(query, F.lit("")) != "", F.concat(below, F.lit("?"), query)).otherwise(below)
    return F.when(F.coalesce(url, F.lit("")) != "", cursor)


def replay_params(cursor: Column | str, page_len: int = 100) -> Column:
    """Query string to replay a cursor with: cursor token first, page length added when absent."""
    c = F.col(cursor) if isinstance(cursor, str) else cursor
    query = F.when(F.locate("?", c) > 0, F.substring_index(c, "?", -1)).otherwise("")
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    token = F.filter(parts, lambda p: p.startswith("cursor="))
    rest = F.filter(parts, lambda p: ~p.startswith("cursor="))
    has_len = F.exists(parts, lambda p: p.startswith("pagelen="))
    none = F.array().cast("array<string>")
    length = F.when(has_len, none).otherwise(F.array(F.lit(f"pagelen={page_len}")))
    return F.array_join(F.concat(token, rest, length), "&")
