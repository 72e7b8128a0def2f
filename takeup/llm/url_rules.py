"""URL filter by association rules mined from labelled URLs, under a fixed list of host rules.

URLs become sets of tokens (scheme, host labels, path words, query keys). A rule "tokens imply block" holds where its share
of the labelled URLs reaches ``min_support`` (the same share at every size), its confidence reaches
``min_confidence``, and the lower bound of the confidence (Wilson, one-sided with ``z``) reaches ``min_lower``, which guards
against chance where few URLs are labelled.

Only minimal rules are kept, as a longer one blocks nothing more. Tokens that are rules by themselves are found by counting and
take no further part; of tokens that occur in exactly the same labelled URLs one stands for all. All combinations among the rest are
searched level by level: each set of tokens is a node that holds the labelled URLs with these tokens, reduced to its possible
further tokens. Every token of a URL takes part, and only what can lead to no minimal rule is left out: sets below the support, sets with
a rule in them, tokens that leave all good URLs of a node in place, and nodes whose bad URLs would not make a rule even
beside only those good ones that have all further tokens.

Each rule is filed under its rarest token, so a URL meets only the rules of its own tokens and then checks the rest of
the combination.

Fixed rules (host, path) hold for a host and its subdomains when the path starts with theirs;
the longest wins and overrides what was mined. Without any matching rule a URL is allowed.

A null URL or one without ``://`` has empty host and path and no tokens. Verdicts of mined rules
are found once per distinct URL, so repeated rows cost one lookup; null and very frequent URLs and tokens are spread
(``operators.lookup``). Labels without a page, pages
without a label and null labels are left out of mining. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from takeup.llm.common import stage
from takeup.operators.lookup import keyed_lookup

# fixed values: verdict, rule
HOST_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
              ("block", "net/fr/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = f"if(instr({url}, '://') > 0, substring({url}, instr({url}, '://') + 3), '')"
    host = F.expr(f"coalesce(translate(regexp_extract({rest}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                  "'abcdefghijklmnopqrstuvwxyz'), '')")
    return host, F.expr(f"coalesce(regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1), '')")


def host_rule(host: str, path: str, rules=HOST_RULES) -> Column:
    """The longest fixed rule that fits, or null; as many conditions as rules."""
    out = None
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, prefix = rule.partition("/")
        fits = ((F.col(host) == name) | F.col(host).endswith("." + name)) & F.col(path).startswith(slash + prefix)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out


def tokens(url: str) -> Column:
    """Distinct tokens of a URL; numbers inside a path count as one token."""
    scheme = f"array(concat('s:', split_part({url}, '://', 1)))"
    labels = "transform(split(host, '[.]'), x -> concat('h:', x))"
    words = "transform(filter(split(regexp_replace(lower(path), '[0-9]+', '/#/'), '[/._-]'), x -> x <> ''), x -> concat('p:', x))"
    query = f"regexp_extract({url}, '[?]([^#]*)', 1)"
    keys = f"transform(filter(split({query}, '&'), x -> x <> ''), x -> concat('q:', split_part(x, '=', 1)))"
    return F.expr(f"if(host = '', cast(array() as array<string>), array_distinct(concat({scheme}, {labels}, {words}, {keys})))")


def tokenized(pages: DataFrame, url_column: str) -> DataFrame:
    host, path = host_and_path(f"`{url_column}`")
    return pages.withColumn("host", host).withColumn("path", path).withColumn("tokens", tokens(f"`{url_column}`"))


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a share."""
    share = hits / n
    spread = F.sqrt(share * (1 - share) / n + F.lit(z * z) / (4 * n * n))
    return (share + F.lit(z * z) / (2 * n) - F.lit(z) * spread) / (1 + F.lit(z * z) / n)


def mine(labelled: DataFrame, min_support: float = 0.004, min_confidence: float = 0.6, min_lower: float = 0.5,
         z: float = 2.33) -> DataFrame:
    """All minimal rules ``(rule, confidence, support)`` from rows ``tokens`` and boolean ``bad``; the support is the share of the
    labelled URLs that have the tokens and are bad."""
    items = labelled.where("size(tokens) > 0").select("tokens", "bad", F.monotonically_increasing_id().alias("row"))
    items = stage(items, "url_items")
    total = items.count()
    share, n, hits = F.col("hits") / F.lit(max(total, 1)), F.col("n"), F.col("hits")

    def makes_rule(hits: Column, n: Column) -> Column:
        return (hits / F.lit(max(total, 1)) >= min_support) & (hits / n >= min_confidence) & (lower_bound(hits, n, z) >= min_lower)

    holds = makes_rule(hits, n)
    one = items.select("row", "bad", F.explode("tokens").alias("token"))
    # a hash over the rows tells sets of rows apart
    single = stage(one.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("hits"),
        F.bit_xor(F.xxhash64("row", F.lit(7))).alias("rows")), "url_tokens_counted")
    measured = [(hits / n).alias("confidence"), share.alias("support")]
    alone = single.where(holds).select(F.array("token").alias("rule"), *measured)
    # tokens in exactly the same rows are one; what can never reach the support takes no part
    rest = single.where(~holds & (share >= min_support)).groupBy("n", "hits", "rows").agg(F.min("token").alias("token"))
    picked = one.join(rest.select("token"), "token").groupBy("row", "bad").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    bad, good = F.sum(F.col("bad").cast("long")).alias("bad"), F.sum((~F.col("bad")).cast("long")).alias("good")
    # URLs with equal tokens are one row
    rows = stage(picked.groupBy("tokens").agg(bad, good).select(F.lit(0).cast("long").alias("node"), "tokens", "bad", "good"),
                 "url_baskets")
    nodes = rows.groupBy("node").agg(F.sum("good").alias("all_good")).withColumn("head", F.array().cast("array<string>"))
    rules = None
    while not rows.isEmpty():
        longer, rows, nodes = extend(rows, nodes, rules, makes_rule, share >= min_support)
        rules = longer if rules is None else stage(rules.unionByName(longer), "url_rules")
    return alone if rules is None else alone.unionByName(rules.select("rule", *measured))


def extend(rows: DataFrame, nodes: DataFrame, rules: DataFrame | None, makes_rule, frequent: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One token more: the rules ``(rule, hits, n)`` that appear, and the rows and nodes of the next level.

    ``rows`` are ``(node, tokens, bad, good)``, the tokens being those of the URLs that may extend the node's ``head``; ``nodes``
    are ``(node, head, all_good)``, ``rules`` those that are known.
    """
    counted = rows.select("node", F.explode("tokens").alias("token"), "bad", "good").groupBy("node", "token").agg(
        F.sum("bad").alias("hits"), F.sum(F.col("bad") + F.col("good")).alias("n"))
    # a token in all good URLs of the node adds nothing to any rule
    found = lookup(counted.where(frequent), nodes, ["node"]).where(F.col("n") - F.col("hits") < F.col("all_good"))
    found = stage(found.select("node", "token", "hits", "n", F.array_sort(F.concat("head", F.array("token"))).alias("rule")), "url_sets")
    if rules is not None:
        found = stage(found.join(containing(found, rules), "rule", "left_anti"), "url_sets_kept")
    new = makes_rule(F.col("hits"), F.col("n"))
    longer = stage(found.where(new & (F.size("rule") > 1)).select("rule", "hits", "n"), "url_rules_found")
    # the rarest tokens of a node go first, so that those of nearly all its URLs are the further tokens of most nodes
    tails = found.where(~new).groupBy("node").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tail"))
    ordered = lookup(rows, tails, ["node"]).where("tail is not null").select(
        "node", "bad", "good", F.size("tail").alias("width"), "tail", F.array_intersect("tail", "tokens").alias("tokens"))
    steps = stage(ordered.select("node", "bad", "good", "width", "tail", F.posexplode("tokens").alias("at", "token"), "tokens").select(
        "node", "token", "bad", "good", (F.col("width") - F.array_position("tail", F.col("token"))).alias("further"),
        F.expr("slice(tokens, at + 2, size(tokens))").alias("tokens")).where("further > 0").groupBy(
            "node", "token", "further", "tokens").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "url_steps")
    # good URLs that stay whatever is added
    core = steps.groupBy("node", "token").agg(F.sum(F.when(F.size("tokens") == F.col("further"), F.col("good")).otherwise(0)).alias("core"))
    open_ = found.join(core, ["node", "token"]).where(makes_rule(F.col("hits"), F.col("hits") + F.col("core")))
    after = stage(open_.select(F.monotonically_increasing_id().alias("next"), "node", "token", "rule",
                               (F.col("n") - F.col("hits")).alias("all_good")), "url_nodes")
    going = lookup(steps.where("size(tokens) > 0"), after.select("node", "token", "next"), ["node", "token"]).where("next is not null")
    going = going.groupBy(F.col("next").alias("node"), "tokens").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    return longer, stage(going, "url_rows"), after.select(F.col("next").alias("node"), "all_good", F.col("rule").alias("head"))


def lookup(rows: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Few rows are broadcast, as each may hold a list of all frequent tokens."""
    return keyed_lookup(rows, table, on, max_rows=20_000)


def containing(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Those ``rule`` of ``sets`` that have one of ``rules`` as a part, met by token."""
    a = sets.select(F.col("rule").alias("whole"), F.explode("rule").alias("token"))
    b = rules.select(F.col("rule").alias("part"), F.explode("rule").alias("token"))
    met = a.join(b, "token").groupBy("whole", "part").agg(F.count("*").alias("common"))
    return met.where("common = size(part)").select(F.col("whole").alias("rule")).distinct()


def matches(urls: DataFrame, rules: DataFrame, counts: DataFrame) -> DataFrame:
    """Best mined rule of each distinct ``url`` with ``tokens``, by inverted index on the rarest token."""
    rarest = rules.select("rule", "confidence", "support", F.explode("rule").alias("token")).join(counts, "token").groupBy(
        "rule", "confidence", "support").agg(F.min(F.struct("n", "token")).alias("r"))
    # one row per token, with its rules: a table as large as the rules
    index = rarest.groupBy(F.col("r.token").alias("token")).agg(
        F.collect_list(F.struct("confidence", "support", "rule")).alias("rules"))
    met = keyed_lookup(urls.select("url", "tokens", F.explode("tokens").alias("token")), index, ["token"], spread_by=["url"])
    hits = met.where("rules is not null").select("url", "tokens", F.explode("rules").alias("r")).where(
        F.size(F.array_except("r.rule", "tokens")) == 0)
    best = F.max("r").alias("b")
    return hits.groupBy("url").agg(best).select(
        "url", F.array_join("b.rule", "+").alias("mined_rule"), F.col("b.confidence").alias("mined_confidence"))


def judge_urls(pages: DataFrame, labels: DataFrame, id_column: str = "page_id", url_column: str = "url",
               label_id_column: str = "doc_id", host_rules=HOST_RULES, **mining) -> DataFrame:
    """``labels`` says ``quality`` (0 is bad) and ``toxic`` (1 is bad) of some ids; ``mining`` are options of ``mine``."""
    rows = stage(tokenized(pages.select(F.col(id_column).alias("id"), F.col(url_column).alias("url")), "url"), "url_tokens")
    bad = labels.select(F.col(label_id_column).alias("id"), F.expr("quality = 0 or toxic = 1").alias("bad"))
    # the label joins by id; pages are one narrow row each
    labelled = rows.join(bad.where("bad is not null"), "id").select("tokens", "bad")
    rules = stage(mine(labelled, **mining), "minimal_url_rules")
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    found = matches(rows.where("size(tokens) > 0").select("url", "tokens").distinct(), rules, counts)
    rows = keyed_lookup(rows, found, ["url"], spread_by=["id", "host"]).withColumn("rule", host_rule("host", "path", host_rules))
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in host_rules for x in (rule, verdict)])
    mined = F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_column), "host", "path", "rule",
                       F.coalesce(verdicts[F.col("rule")], mined).alias("verdict"), "mined_rule", "mined_confidence")
