"""Pseudonyms, URL filter and WARC derivatives against plain versions; what must stay in the JVM does."""

import base64
import datetime
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import pseudonyms, url_filter, warc
from helixframe.llm.queries import URL_RULES

from . import brute

KEY = "k"


def feistel(left, right, a, b, tweak):
    for i in range(8):
        digest = lambda x, m: int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{x}".encode()).hexdigest()[:15], 16) % m  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + digest(right, a)) % a
        else:
            right = (right + digest(left, b)) % b
    return left, right


def chars(text, tweak):
    out = ""
    classes = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for k in range(0, len(text), 24):
        part = text[k : k + 24]
        sets = [next(s for s in classes if c in s) for c in part]
        h = len(part) // 2

        def number(lo, hi):
            v = m = 0
            m = 1
            for c, s in zip(part[lo:hi], sets[lo:hi]):
                v, m = v * len(s) + s.index(c), m * len(s)
            return v, m

        (x, a), (y, b) = number(0, h), number(h, len(part))
        x, y = feistel(x, y, a, b, f"{tweak}/{k // 24}")
        spelt = ["", ""]
        for side, v, ss in ((0, x, sets[:h]), (1, y, sets[h:])):
            for s in reversed(ss):
                spelt[side] = s[v % len(s)] + spelt[side]
                v //= len(s)
        out += "".join(spelt)
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def refill(form, new, pattern):
    it = iter(new)
    return "".join(next(it) if re.match(pattern, c) else c for c in form)


def pseudonym(m):
    digits = re.sub("[^0-9]", "", m)
    if "@" in m:
        name, domain = m.split("@")
        return refill(name, chars(re.sub("[^A-Za-z0-9]", "", name), "mail"), "[A-Za-z0-9]") + "@" + domain
    if re.fullmatch(r"(\d+\.){3}\d+", m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return m
        a, b = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if d := re.fullmatch(r"(\d{4})([-/])(\d\d)\2(\d\d)|(\d\d)([./])(\d\d)\6(\d{4})", m):
        tries = [("%Y%m%d", d[1], d[3], d[4])] if d[1] else [("%d%m%Y", d[8], d[7], d[5])] + ([("%m%d%Y", d[8], d[5], d[7])] if d[6] == "/" else [])
        for form, *ymd in tries:
            try:
                day = datetime.date(*map(int, ymd))
            except ValueError:
                continue
            if day.year < 1600:
                return m
            first = datetime.date(day.year - day.year % 400, 1, 1)
            n = (day - first).days
            a, b = feistel(n // 773, n % 773, 189, 773, "date")
            new = first + datetime.timedelta(days=a * 773 + b)
            y, mo, dd = f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"
            return refill(m, {"%Y%m%d": y + mo + dd, "%d%m%Y": dd + mo + y, "%m%d%Y": mo + dd + y}[form], "[0-9]")
        return m
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        a, b = feistel(area - (1 if area < 666 else 2), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
        return f"{a + (1 if a < 665 else 2):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"
    if not re.fullmatch(pseudonyms.PHONE, m) and re.fullmatch(pseudonyms.MARKED, m):
        return marked_phone(m)
    if re.fullmatch(pseudonyms.PHONE, m):
        own = digits[-10:]
        a, b = feistel(int(own[:3]) - 200, int(own[3:]) - 2_000_000, 800, 8_000_000, "phone")
        return refill(m, digits[:-10] + str(a + 200) + str(b + 2_000_000), "[0-9]")
    if re.fullmatch(pseudonyms.ABROAD, m):
        return "+" + digits[:-6] + chars(digits[-6:], "abroad")
    if not luhn(digits):
        return m
    body = digits[0] + chars(digits[1:-1], "card")
    return refill(m, next(body + str(c) for c in range(10) if luhn(body + str(c))), "[0-9]")


SAMPLES = ["mail bosbt.42@mail8.example.com; A.Very_long+name-with.many.letters.1234567890@x.org", "ip 42.144.35.254. or 300.1.1.1", "+1 (988) 555-2485 (988) 555-2485, 988-555-2485 1-988-555-2485", "4041894974608795 4041 8949 7460 8795 4041894974608796 378282246310005", "2024-02-29 2023-02-29 31.12.1999 12/31/1999 31/12/1999 1500-01-01 2024/01/01", "123-45-6789 666-45-6789 000-12-1234", "+4917012345678", "a@b.co 1@c.org", "no numbers", "", "$1 \\ 5 (x) 12345678901234567890", "99.5 3.14 1.2.3"]


def test_pseudonyms_equal_plain_version(spark):
    r = random.Random(1)
    texts = [*SAMPLES, None, " ".join(SAMPLES) * 20]
    for _ in range(60):
        card = "4" + "".join(r.choice("0123456789") for _ in range(r.randint(11, 17)))
        texts.append(f"x {next(card + str(c) for c in range(10) if luhn(card + str(c)))} {r.randint(0, 299)}.{r.randint(0, 260)}.1.{r.randint(0, 255)} ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(0, 9999):04} {r.randint(1500, 2400)}-{r.randint(1, 13):02}-{r.randint(1, 31):02} {r.choice('abcXYZ')}{r.randint(1, 99)}@mail.org")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS matches", "2 AS Renamed")
    out = pseudonyms.pseudonymise(df, KEY, found_col="n")
    assert out.columns == [*df.columns, "n"]
    for row in out.collect():
        t = texts[row.doc_id]
        if t is None:
            assert row.text is None and row.n == 0
            continue
        found = [m[0] for m in re.finditer(pseudonyms.PATTERN.replace("\\1", "(?:\\1)").replace("\\2", "(?:\\2)"), t)]
        assert row.text == re.sub(pseudonyms.PATTERN, lambda m: pseudonym(m[0]), t)
        assert row.n == sum(pseudonym(m) != m for m in found)


def test_feistel_is_a_permutation(spark):
    a, b = 13, 7
    pairs = spark.range(a * b).select(pseudonyms.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), F.lit(KEY), F.lit("t")).alias("x")).select("x.*").collect()
    assert len({(r.l, r.r) for r in pairs}) == a * b and all(0 <= r.l < a and 0 <= r.r < b for r in pairs)


def marked_phone(m):
    """The plain version of a marked number of any area and exchange."""
    digits = re.sub("[^0-9]", "", m)
    area, rest = int(digits[-10:-7]), int(digits[-7:])
    a, b, x, y = (0, 0, 200, 10_000_000) if area < 200 else (200, 0, 800, 2_000_000) if rest < 2_000_000 else (200, 2_000_000, 800, 8_000_000)
    left, right = feistel(area - a, rest - b, x, y, "phone")
    return refill(m, f"{digits[:-10]}{left + a:03}{right + b:07}", "[0-9]")


def test_marked_phone_numbers_of_any_area(spark):
    r = random.Random(2)
    marked = ["+1 (017) 555-7713", "+1 (132) 555-1352", "(017) 555-7713", "+1 017 555 7713", "+1-017-555-7713", "1-017-555-7713", "1 (017) 555-7713", "(988) 155-2485", "+1 (988) 055-2485", "(988) 555-2485", "+1 (000) 000-0000", "(999)999-9999"]
    marked += [f"+1 ({r.randint(0, 999):03}) {r.randint(0, 999):03}-{r.randint(0, 9999):04}" for _ in range(300)]
    plain = ["017-555-7713", "1 017 555 7713", "x(017) 555-7713", "(017) 555-77134", "(17) 555-7713", "1,017 555-7713"]
    df = spark.createDataFrame([(i, f"call {m}, now") for i, m in enumerate(marked + plain)], "doc_id long, text string")
    got = {x.doc_id: (x.text, x.n) for x in pseudonyms.pseudonymise(df, KEY, found_col="n").collect()}
    assert [got[i] for i in range(len(marked))] == [(f"call {marked_phone(m)}, now", int(marked_phone(m) != m)) for m in marked]
    assert [got[len(marked) + i] for i in range(len(plain))] == [(f"call {m}, now", 0) for m in plain]
    own = lambda t: re.sub("[^0-9]", "", t)[-10:]
    assert len({own(got[i][0]) for i in range(len(marked))}) == len({own(m) for m in marked})


def test_native_plans_have_no_python(spark, capsys):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    for df in (pseudonyms.pseudonymise(docs, KEY), url_filter.filter_urls(pages, pages, URL_RULES)):
        df.explain("extended")
        assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


URLS = [None, "", "no scheme", "http://Example.COM/en/7?x", "https://www.example.com/en/8#top", "ftp://example.net/de/85", "http://x.example.net/de/9", "http://net", "http://org/es/", "http://norg/es/", "http://a.org/es", "http://e.com://x/en/1", "://com/en/", "http://com?/en/", "http://user@spam.example.com:80/list/?b=2&a=1&utm_source=x#f", "HTTP://WWW.spam.example.com/list?a=1&b=2", "http://spam.example.com/list?a=1", "http://other.example.fr/İ"]


@pytest.mark.parametrize("blocks", [1 << 15, 1])
def test_url_filter(spark, blocks):
    rows = [(i % 15, u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS block", "3 AS key")
    listed = spark.createDataFrame([("http://spam.example.com/list/?a=1&b=2",), (None,), ("nothing",), ("http://spam.example.com/list/?b=2&a=1",)], "url string")
    rules = [(r.verdict, r.host, r.path) for r in URL_RULES]
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, listed, URL_RULES, blocks=blocks).collect())
    want = []
    for i, u in rows:
        host, path, rule, verdict = brute.url(u, rules)
        hit = u in ("HTTP://WWW.spam.example.com/list?a=1&b=2",)
        want.append((i, host, path, rule or "", verdict or ("block" if hit else "allow")))
    assert got == sorted(want)
    assert url_filter.filter_urls(pages, listed.limit(0), []).filter("verdict <> 'allow' OR rule IS NOT NULL").count() == 0


def test_warc_derivatives(spark, tmp_path):
    page = "<html><head><title>T &amp; x</title><script>var t='</p>'</script></head><body><!-- no --><h1>Head</h1><p>One&nbsp;two <b>th</b>ree<br>four <a href='/l?a=1&amp;b'>L</a></p><style>p{}</style></body></html>"
    pages = spark.createDataFrame([(1, "http://x.org/", page), (2, None, None), (3, "http://y.org/", "")], "page_id long, url string, html string")
    made = warc.responses(pages)
    rows = {r.page_id: (bytes(r.response), r.d) for r in made.withColumn("d", warc.derive(F.col("response"))).collect()}
    raw, d = rows[1]
    names, _, block = warc.parse(raw)
    assert d.status == "ok" and d.refers_to == names["warc-record-id"] and d.payload_ok and d.title == "T & x" and d.n_links == 1
    assert d.text == "Head\nOne two three\nfour L"
    for kind, ident in (("metadata", d.metadata_id), ("conversion", d.conversion_id)):
        own, _, body = warc.parse(bytes(d[kind]))
        assert own["warc-type"] == kind and own["warc-record-id"] == ident and own["warc-refers-to"] == d.refers_to
        assert own["warc-target-uri"] == "http://x.org/" and own["warc-date"] == names["warc-date"] and own["warc-payload-digest"] == names["warc-payload-digest"]
        assert own["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert warc.parse(bytes(d.conversion))[2].decode() == d.text
    meta = warc.parse(bytes(d.metadata))[2].decode()
    assert "http-header-Content-Type: text/html; charset=utf-8\r\n" in meta and "outlink: /l?a=1&b\r\n" in meta and "http-status-line: HTTP/1.1 200 OK\r\n" in meta
    assert rows[2][1].status == "ok" and rows[2][1].target_uri is None and rows[2][1].text == ""
    assert [warc.derive_one(x)["status"] for x in (None, b"", b"WARC/1.0\r\n", b"junk\r\n\r\nx", raw.replace(b"response\r\nWARC-Record", b"request\r\nWARC-Record", 1), raw[:-10])] == ["empty", "empty", "malformed", "malformed", "not a response", "malformed"]
    all_ = b"".join(rows[i][0] for i in (1, 2, 3))
    (tmp_path / "a.warc").write_bytes(all_)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(rows[i][0]) for i in (1, 2, 3)))
    read = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.record) for r in read) == sorted([rows[i][0] for i in (1, 2, 3)] * 2)


def test_read_warc_goes_on_after_malformed_records(spark, tmp_path):
    good = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>"), ("Content-Type", "text/plain")], b"a\r\n\r\nWARC/ in a block\r\nWARC/1.1 too") for i in range(4)]
    bad = [b"WARC/1.1\r\nWARC-Type: response\r\n\r\nno length\r\n", b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\n", b"WARC/1.1\r\nheader breaks off\r\n", b"no record at all\r\n"]
    want = [bad[3], good[0], bad[0], good[1], bad[1], good[2], bad[2], good[3], bad[0]]
    (tmp_path / "x.warc").write_bytes(b"".join(want))
    rows = sorted((r.place, bytes(r.record)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert rows == list(enumerate(want))
    assert [warc.parse(r) is None for _, r in rows] == [w not in good for w in want]


def test_read_warc_in_small_pieces(spark, tmp_path):
    want = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>")], b"x" * i * 7) for i in range(40)]
    (tmp_path / "a.warc").write_bytes(b"".join(want))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(want)))
    (tmp_path / "c.warc.gz").write_bytes(b"".join(map(gzip.compress, want))[:-5])
    rows = warc.read_warc(spark, str(tmp_path), piece_bytes=64).collect()
    for name, n in (("a.warc", 40), ("b.warc.gz", 40), ("c.warc.gz", 39)):
        assert [bytes(r.record) for r in sorted(rows, key=lambda r: r.place) if r.path.endswith(name)][:n] == want[:n]


def test_read_warc_keeps_what_a_wrong_length_would_swallow(spark, tmp_path):
    good = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>")], b"a\r\n\r\nWARC/1.1 in a block " * (i + 1)) for i in range(4)]
    for name, size in (("past the end", b"99999"), ("over the next", b"300")):
        bad = re.sub(rb"Content-Length: \d+", b"Content-Length: " + size, warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:bad>")], b"short"), flags=re.I)
        d = tmp_path / name
        d.mkdir()
        (d / "x.warc").write_bytes(good[0] + bad + good[1] + good[2] + good[3])
        rows = [bytes(r.record) for r in sorted(warc.read_warc(spark, str(d), 64).collect(), key=lambda r: r.place)]
        assert [r for r in rows if warc.parse(r)] == good and len(rows) == 5
        assert warc.derive_one(rows[1])["status"] == "malformed"


def test_read_warc_goes_on_after_a_broken_member(spark, tmp_path):
    good = [warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:x:{i}>")], bytes(range(256)) * (i + 3)) for i in range(4)]
    members = [gzip.compress(g) for g in good]
    broken = bytearray(members[1])
    broken[40] ^= 0xFF
    broken[60] ^= 0xFF
    (tmp_path / "a.warc.gz").write_bytes(members[0] + bytes(broken) + members[2] + members[3])
    (tmp_path / "b.warc.gz").write_bytes(members[0] + members[1][:-20] + members[2])
    for name, want in (("a.warc.gz", [good[0], good[2], good[3]]), ("b.warc.gz", [good[0], good[2]])):
        rows = [bytes(r.record) for r in sorted(warc.read_warc(spark, str(tmp_path / name)).collect(), key=lambda r: r.place)]
        whole = [r for r in rows if warc.parse(r)]
        assert [r for r in whole if r in want] == want and len(rows) > len(want)


def test_head_without_end_tag():
    inside = "<head><meta charset=utf-8>\n<title>t</title><script>x = '<p>no</p>'</script><!-- <p>no</p> --><style>p {}</style>"
    for body in ("<body>yes", "<p>yes", "yes"):
        assert warc.plain_text(inside + body) == "yes"
    assert warc.plain_text(inside + "</head><p>yes") == "yes" and warc.plain_text(inside + "no</head><p>yes") == "yes"
    assert warc.plain_text("a<script>no") == "a" and warc.plain_text("<head><script>no") == ""


@pytest.mark.parametrize("page,title,links,text", [
    ("", None, [], ""),
    ("a < b <3 <!x> c</b> d<", None, [], "a < b <3 c d<"),
    ("<A HREF=x>l</A> <a title='>' href = \"y&amp;z\">m</a><a>n", None, ["x", "y&z"], "l mn"),
    ("<title>one</title><TITLE>two</TITLE>", "one", [], "onetwo"),
    ("x<!-- open <p>y", None, [], "x"),
    ("<p>a<br>b</p>c<hr/>d\ne", None, [], "a\nb\nc\nd e"),
    ("a<p unclosed b", None, [], "a<p unclosed b"),
    ("<svg:a href=1>x</svg:a>&lt;p&gt;", None, [], "x<p>"),
])
def test_page(page, title, links, text):
    p = warc.Page(page)
    assert (p.title, p.links, p.text) == (title, links, text)


def test_broken_pages_take_linear_time():
    import time

    for unit in ("<!--", "<title>", "<a ", '<a href="', "<", "<a \"'>", "<script ", "<head>", "<p>x ", "</", "&", "<title>x</title>", "<head><title>"):
        for page in (unit * (1_000_000 // len(unit)), unit * (1_000_000 // len(unit)) + "</title></head>'\">"):
            start = time.process_time()
            warc.Page(page)
            assert time.process_time() - start < 5
