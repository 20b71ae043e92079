"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Rules are few (a parameter) and become one expression. The list may be large: each of its canonical URLs sets one
bit in each of the eight 32-bit words of one block, the filter is put together by a grouped bit_or, grows with the
list and has at most ``MOST_BLOCKS`` rows, so it is broadcast. URLs that it surely doesn't hold are settled by that; possible
hits go to an exact join with the list on the hash and the canonical URL, which removes the false positives. A list
too long for the filter costs time in that join, never a wrong verdict. Only built-in expressions are used.

Canonical form: no scheme, host in lower case without ``www.`` or ``m.`` and default port, no fragment, no tracking
parameters, other parameters sorted, no slash at the path's end. A URL without ``://`` stands for itself.

Defined results: a null URL has an empty host and path, no rule and is allowed; repeated rows get equal results; a very long
URL is judged whole, by linear patterns; of rules that fit the longest wins, and no two are equally long for one URL;
an empty table of pages gives no rows; null ids are kept; an empty list blocks nothing; other columns of the
input, whatever their names, aren't looked at.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm._session import checkpointed


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Parameters that say where a visitor came from.
TRACKING = "(utm_[a-z]+|ref|gclid|fbclid)"
#: The eight odd multipliers that choose a bit in each word of a block; fixed values of the published split-block filter.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


#: Bound of the filter, some 25 MB.
MOST_BLOCKS = 1 << 18


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.expr("substr(_url, locate('://', _url) + 3)"))


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows with ``host`` and ``path``."""
    rest = F.coalesce(_rest(F.col("_url")), F.lit(""))
    out = pages.withColumn("_url", F.col(url_col)).withColumn("_rest", rest)
    raw = F.regexp_extract("_rest", "^[^/?#]*", 0)
    out = out.withColumn("host", F.translate(raw, string.ascii_uppercase, string.ascii_lowercase))
    return out.withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one asked wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def canonical(host: Column, path: Column, rest: Column, url: Column) -> Column:
    """The canonical URL from what with_host_path() has found."""
    name = F.regexp_replace(F.regexp_replace(host, "^(www|m)\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(rest, "^[^?#]*\\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}="))
    shown = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(parts), "&"))).otherwise("")
    return F.when((host == "") & (path == ""), F.trim(url)).otherwise(F.concat(name, F.regexp_replace(path, "/+$", ""), shown))


def _with_canonical(pages: DataFrame, url_col: str) -> DataFrame:
    out = with_host_path(pages, url_col)
    out = out.withColumn("canonical", canonical(F.col("host"), F.col("path"), F.col("_rest"), F.col("_url")))
    return out.withColumn("_hash", F.xxhash64("canonical"))


def _bit(k: int) -> Column:
    spread = F.col("_hash").bitwiseAND(F.lit(0x7FFFFFFF)) * F.lit(SALTS[k])
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 27).bitwiseAND(F.lit(31)).cast("int"))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """At most ``blocks`` rows (block, w0 to w7) from a table with ``_hash``."""
    words = [F.bit_or(_bit(k)).alias(f"w{k}") for k in range(8)]
    return listed.groupBy(_block(blocks).alias("block")).agg(*words)


def _block(blocks: int) -> Column:
    return F.pmod(F.shiftright("_hash", 32), F.lit(blocks)).cast("int")


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, blocks: int | None = None) -> DataFrame:
    """Id, host, path, rule, verdict, listed. ``listed``: a table of URLs to block, in its column ``url``.

    The filter has a block for every twelve URLs of the list, ``MOST_BLOCKS`` at most, unless ``blocks`` is given.
    """
    source = _with_canonical(pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url")), "url")
    list_ = _with_canonical(listed.select("url").where("url is not null"), "url").select("canonical", "_hash").distinct()
    list_ = checkpointed(list_)
    blocks = blocks or max(1, min(MOST_BLOCKS, list_.count() // 12))
    sieve = F.broadcast(bloom_filter(list_, blocks))  # its rows are bounded by ``blocks``
    held = F.lit(True)
    for k in range(8):
        held = held & (F.col(f"w{k}").bitwiseAND(_bit(k)) != 0)
    possible = source.withColumn("_block", _block(blocks)).join(sieve, F.col("_block") == F.col("block"), "left").withColumn("_possible", F.coalesce(held, F.lit(False)))
    columns = ["_id", "host", "path", "canonical", "_hash"]
    exact = list_.withColumn("_listed", F.lit(True))
    hits = possible.where("_possible").select(*columns).join(exact, ["_hash", "canonical"], "left").select("_id", "host", "path", F.coalesce("_listed", F.lit(False)).alias("listed"))
    out = hits.unionByName(possible.where("not _possible").select("_id", "host", "path", F.lit(False).alias("listed")))
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return out.select(F.col("_id").alias(id_col), "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: Words in the host names of unwanted sites, by category.
UNWANTED = {
    "advertising": "ad ads adserver adserving advert adverts adtrack adtracker popads popunder",
    "gambling": "bet bets betting casino casinos gambling jackpot lottery poker roulette slots",
    "pharmacy": "cialis drugstore meds pharma pharmacy pill pills viagra",
    "adult": "adult cams escort escorts nude porn porno sex xxx",
    "spam": "malware phishing scam scams spam warez",
}
#: Such a word between dots or hyphens, with or without a number behind it.
UNWANTED_HOST = rf"(^|[.-])({'|'.join(' '.join(UNWANTED.values()).split())})[0-9]*([.-]|$)"


def unwanted_hosts(pages: DataFrame, url_col: str = "url", pattern: str = UNWANTED_HOST) -> DataFrame:
    """Distinct URLs of pages whose host matches the pattern."""
    found = with_host_path(pages.select(F.col(url_col).alias("url")), "url")
    return found.where(F.col("host").rlike(pattern)).select("url").distinct()
