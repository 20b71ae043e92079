"""HTML text, URL filter, surrogates and the pipeline."""

import re

import corpus_pipeline
import pytest

from tracklake.llm import html_text, pii, urls
from tracklake.llm.html_text import visible_text

PAGE = """<!DOCTYPE html><title>no</title><style>x</style><body><p>A &amp; b<p>C <b>d</b>  e<br>f
<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li><p>three</ul><table><tr><th>Name<th>Qty<tr><td>apple<td>1
<tr><td>kiwifruit</td><td>22</td></table><pre>a
  b</pre><div hidden>no</div><p style="display: none">no</p><script>if(a<b)"<p>no"</script><!-- no --> tail"""
SHOWN = """A & b

C d e
f

- one
- two
  3. x
  4. y

- three

Name       Qty
apple      1
kiwifruit  22

a
  b

tail"""


def test_layout():
    assert visible_text(PAGE) == SHOWN


@pytest.mark.parametrize(
    ("markup", "shown"),
    [(None, ""), ("", ""), ("plain", "plain"), ("a < b & c", "a < b & c"), ("</p></div>x</b>", "x"), ("<p>open", "open"), ("<a title='x>y'>z</a>", "z"), ('<a title="x>y', "y"), ('<a title="x', '<a title="x'), ("<!-- never ends", ""), ("a<br><br>b", "a\n\nb"), ("<table><td>1<td>2", "1  2"), ("<select><option>a<option>b</select>", "a\nb"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<p>a</p>\n\n<p>b</p>", "a\n\nb")],
)
def test_odd_markup(markup, shown):
    assert visible_text(markup) == shown


@pytest.mark.parametrize("markup", ["<div>" * 30000 + "x", '<b "' * 20000, '<b ">' * 20000, "<p>a" * 20000, "<" * 50000, "<ul><li>" * 2000, "<table><tr><td>" * 1000])
def test_deep_or_broken_markup_ends(markup):
    visible_text(markup)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (None, None, None), (2, "", "x")], "page_id long, html string, text string")
    got = html_text.extract_text(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, SHOWN, len(SHOWN)), (1, SHOWN, len(SHOWN)), (2, "", 0)]
    assert html_text.extract_text(df.where("false")).count() == 0


URLS = ["http://a.example.org/es/x?q#f", "https://EXAMPLE.org/en/12", "http://b.com/de/", "http://b.com/fr/x", "http://com/fr/", "http://xcom/de/", "http://casino-x.net/a/?utm_source=1&b=2&a=1#t", "https://www.casino-x.net/a?a=1&b=2", "http://casino-x.net/other", "mailto:x", "", None, "http://org", "http://Ünï.org/x", "a://b://c.org/d", "http://h?x/y"]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, rule and rule.text, rule.verdict if rule else None


@pytest.mark.parametrize("blocks", [1 << 16, 1])
def test_urls(spark, blocks):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://m.casino-x.net/a?a=1&b=2&ref=z",), ("https://b.com/fr/x",), (None,)] + [(f"http://l{k}.net/",) for k in range(200)], "url string")
    got = urls.judge(df, listed, blocks=blocks).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        *expected, verdict = brute(URLS[r.page_id])
        assert [r.host, r.path, r.rule] == expected
        assert r.listed == (r.page_id in (3, 6, 7))
        assert r.verdict == (verdict or ("block" if r.page_id in (6, 7) else "allow"))
    assert {r.listed for r in urls.judge(df, listed.where("false")).collect()} == {False}
    assert urls.judge(df.where("false"), listed).count() == 0


def test_surrogates(spark, odd, none):
    texts = ["A Mail2.Foo@mail7.example.com, mail2.foo@MAIL7.example.com r.23@mail7.example.com", "97.51.17.173 10.1.2.3. 192.168.0.7", "+1 (017) 555-7713 017-555-7713", "9807915762804490 4111 1111 1111 1111 4111111111111111", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "123-45-6789 DE89 3704 0044 0532 0130 00", "Mrs. Anna Schmidt, Mr Schmidt; Госпожа Анна Иванова", "clean 1234 of 3.14", "9807915762804490*** x"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_entities int")
    out = {r.doc_id: r.text for r in pii.with_surrogates(df, "k").collect()}
    mail = re.findall(r"\S+@[\w.]+", out[0])
    assert mail[0].lower() == mail[1].lower() != mail[2].lower() and mail[0][:1].isupper() and len({m.lower().split("@")[1] for m in mail}) == 1
    assert re.fullmatch(r"(\d+\.){3}\d+ 10\.\d+\.\d+\.\d+\. 192\.168\.\d+\.\d+", out[1])
    first, second = re.fullmatch(r"\+1 (\(\d{3}\) \d{3}-\d{4}) (\d{3}-\d{3}-\d{4})", out[2]).groups()
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) != "0175557713"
    cards = re.fullmatch(r"(\d{16}) (\d{4} \d{4} \d{4} \d{4}) (\d{16})", out[3]).groups()
    luhn = lambda n: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10
    assert cards[1].replace(" ", "") == cards[2] and luhn(cards[2]) == 0 and (luhn(cards[0]) == 0) == (luhn("9807915762804490") == 0)
    assert re.fullmatch(r'token = "[0-9a-f]{40}"', out[4]) and out[4] != texts[4]
    assert re.fullmatch(r"\d{3}-\d\d-\d{4} DE[0-9]{2}( \d{4}){4} \d\d", out[5])
    a, b, c = re.fullmatch(r"Mrs\. ([A-Z][a-z]+a [A-Z][a-z]+), Mr ([A-Z][a-z]+); Госпожа ([А-Я][а-я]+а [А-Я][а-я]+)", out[6]).groups()
    assert a.split()[1] == b and "Schmidt" not in out[6]
    assert out[7] == texts[7] and out[8].startswith(cards[0])
    assert {r.doc_id: r.text for r in pii.with_surrogates(df, "other").collect()}[0] != out[0]
    kept = pii.with_surrogates(odd, "k")
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert pii.with_surrogates(none, "k").count() == 0


def test_surrogates_pass_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a.b@mail.example.com", "own", "key")], "doc_id long, text string, _text string, _key string")
    r = pii.with_surrogates(df, "k").first()
    assert (r["_text"], r["_key"]) == ("own", "key") and "a.b@" not in r.text


def test_surrogates_stay_distinct(spark):
    """One-letter addresses have so few surrogates that first draws collide."""
    real = [f"{c}.{k}@m.example.com" for c in "abcdefghijklmnopqrstuvwxyz" for k in range(10)][:200]
    df = spark.createDataFrame([(i, f"write to {e} or {e} soon") for i, e in enumerate(real)], "doc_id long, text string")
    out = {r.doc_id: re.findall(r"\S+@\S+", r.text) for r in pii.with_surrogates(df, "k").collect()}
    assert all(a == b for a, b in out.values())
    assert len({a for a, _ in out.values()}) == 200 and not {a for a, _ in out.values()} & set(real)


def test_surrogates_end_where_a_format_is_full(spark):
    """All one-digit addresses of a domain, a secret without letters and digits, and more than half of 192.168.*."""
    real = [f"{k}@m.example.com" for k in range(10)] + ["password: --------"] + [f"192.168.{k // 256}.{k % 256}" for k in range(33000)]
    out = pii.surrogate_table(spark.createDataFrame([(e,) for e in real], "e string"), "k", most_draws=2).collect()
    made = [r.shown for r in out]
    assert sorted(r.e for r in out) == sorted(real) and len(set(made)) == len(real) and not set(made) & set(real)
    assert all(re.fullmatch(r"\d+@[a-z]+\.example\.com|password: --------\d+|(10\.\d+|192\.168)\.\d+\.\d+", m) for m in made)


@pytest.mark.parametrize(("kind", "canon", "made"), [("surname", "иванова", "[А-Я][а-я]{9,}"), ("given_f", "anna", "[A-Z][a-z]{7,}a"), ("card", "4111111111111111", r"\d{18}"), ("ip", "10.1.2.3", r"10(\.\d+){3}"), ("ssn", "123456789", r"\d{11}"), ("iban", "DE89370400440532013000", r"DE\d{22}")])
def test_later_draws_are_longer(spark, kind, canon, made):
    df = spark.createDataFrame([(kind, canon, 65)], "kind string, canon string, attempt int")
    assert re.fullmatch(made, pii.atom_surrogates(df, "k").first().made)


def test_longer_numbers_keep_their_format(spark):
    df = spark.createDataFrame([("+1 (017) 555-7713", "phone", "0175557713", "123456789012")], "e string, _kind string, canon1 string, made1 string").selectExpr("*", "'' as _title", "cast(null as string) as made2")
    assert pii.dressed(df).first().shown == "+1 (123) 456-789012"


def test_pipeline(spark, tmp_path, odd):
    rows = [(i, f"{'good words ' if i % 4 else '#### $$$$ '}" + " ".join(f"w{(i * 37 + j * j * (i + 3)) % 997}" for j in range(80)) + (f" mail a{i}b@x.example.com" if i % 5 == 0 else ""), "en", "s", 5) for i in range(80)]
    rows += [(1000, rows[1][1], "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").union(odd.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is null or doc_id >= 100"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= {r[0] for r in rows} | {None} and not {1, 1000} <= ids
    assert all(r.offset + r.length <= 2048 for r in out)
    assert len(corpus_pipeline.STAGES) == 5
