from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from onset.llm import common, exact_dedup, licenses, quality_rules, url_filters
from onset.llm.queries import op3_licenses, op6_quality_rules, op7_exact_dedup, op8_url_filters
from tests.llm.samples import ODD, SCHEMA, SF, documents, odd, ordered

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_query(spark):
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()
    counts = [brute_counts(r["text"]) for r in table]
    bad = brute_bad_hosts([(r["source"], c[-1]) for r, c in zip(table, counts, strict=True)])
    want = [(r["doc_id"], *c, not c[-1] and r["source"] not in bad) for r, c in zip(table, counts, strict=True)]
    assert ordered(op6_quality_rules(spark, SF).collect()) == ordered(want)


def brute_bad_hosts(flags: list[tuple[str | None, bool]], limit: float = 0.5, z: float = 1.645) -> set[str]:
    """Hosts whose posterior failure rate is surely far above the mean."""
    hosts: dict[str, list[bool]] = {}
    for host, failed in flags:
        if host is not None:
            hosts.setdefault(host, []).append(failed)
    if not hosts:
        return set()
    sizes, bad = [len(x) for x in hosts.values()], [sum(x) for x in hosts.values()]
    n = sum(sizes)
    mean = min(max(sum(bad) / n, 1e-6), 1 - 1e-6)
    room = n - sum(x * x for x in sizes) / n
    strength = 10.0
    if len(hosts) > 1 and room > 0:
        between = (sum(b * b / k for b, k in zip(bad, sizes, strict=True)) - n * mean * mean) / (mean * (1 - mean)) - (len(hosts) - 1)
        rho = min(max(between / (room - (len(hosts) - 1)) if room > len(hosts) - 1 else 0.0, 1e-3), 0.5)
        strength = (1 - rho) / rho
    found = set()
    for host, k, b in zip(hosts, sizes, bad, strict=True):
        rate = (b + mean * strength) / (k + strength)
        if rate - z * (rate * (1 - rate) / (k + strength + 1)) ** 0.5 > mean + limit * (1 - mean):
            found.add(host)
    return found


def test_host_verdicts_against_brute_force(spark):
    """Hosts of all rates and sizes, one with a third of all rows."""
    rng = random.Random(9)
    flags = [(h, rng.random() < rate) for h, rate, n in [("hot", 0.05, 2000), ("all", 1.0, 60), ("most", 0.85, 300), ("half", 0.5, 300), ("few", 1.0, 2), ("none", 0.0, 400), *((f"h{i}", rng.random() ** 3, rng.randrange(1, 200)) for i in range(30))] for _ in range(n)]
    flags += [(None, True)] * 50
    rates = quality_rules.host_rates(spark.createDataFrame(flags, "host string, base_failed boolean")).collect()
    want = brute_bad_hosts(flags)
    assert {r["host"] for r in rates if r["rejected"]} == want and {"all", "most"} <= want and not want & {"hot", "half", "few", "none"}


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "x " * 9, " ".join(f"w{i % 11}" for i in range(60)) + " end " + " ".join(f"w{i % 13}" for i in range(60)), "a b c d e f g h i j k"])
def test_windows_of_one_hash_are_told_apart(spark, text):
    """All windows have one hash, or one of two."""
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    for hash_ in (lambda w: F.lit(1).cast("long"), lambda w: F.xxhash64(w) % 2):
        row = quality_rules.signals(docs, hash_=hash_).first()
        assert tuple(row[c] for c in quality_rules.COUNTS) == brute_counts(text)[:-1]


def test_quality_odd_rows(spark):
    rows = quality_rules.quality_rules(odd(spark)).collect()
    assert ordered((r["doc_id"], *(r[c] for c in quality_rules.COUNTS), r["base_failed"]) for r in rows) == ordered((r[0], *brute_counts(r[1])) for r in ODD)
    kept = quality_rules.drop_rejected(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == sum(r["kept"] for r in rows)
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality_rules.drop_rejected(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bad_hosts_go_whole(spark):
    """One host fails nearly always, a hot one and a null one hardly ever."""
    good = " ".join(f"word{i}" for i in range(40))
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 3 == 0, "bad").when(F.col("id") % 5 == 0, None).otherwise(F.concat(F.lit("h"), F.col("id") % 7)).alias("source"),
        F.when((F.col("id") % 2 == 1) & (F.col("id") % 3 == 0) & (F.col("id") % 30 != 3), "too short").otherwise(good).alias("text"),
    )
    rows = quality_rules.quality_rules(docs)
    assert {r[0] for r in rows.where("host_rejected").select("host").distinct().collect()} == {"bad"}
    assert rows.where("not base_failed and not kept").count() == rows.where("host = 'bad' and not base_failed").count() > 0
    assert ordered(quality_rules.drop_rejected(docs).select("doc_id").collect()) == ordered(rows.where("kept").select("doc_id").collect())


def test_many_bad_hosts_are_salted(spark, monkeypatch):
    few = quality_rules.quality_rules(odd(spark), host_limit=0.0)
    want = ordered(few.collect())
    kept = ordered(quality_rules.drop_rejected(odd(spark), host_limit=0.0).select("doc_id").collect())
    monkeypatch.setattr(common, "FEW", 0)
    assert ordered(quality_rules.quality_rules(odd(spark), host_limit=0.0).collect()) == want
    assert ordered(quality_rules.drop_rejected(odd(spark), host_limit=0.0).select("doc_id").collect()) == kept


def brute_dedup(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    groups: dict[str, list] = {}
    for key, text in rows:
        groups.setdefault((text or "").translate(_UPPER), []).append(key)
    out = []
    for text, keys in groups.items():
        keep = max((k for k in keys if k is not None), default=None)
        stays = False
        for k in keys:
            kept = k == keep and not stays
            stays |= kept
            out.append((k, keep, len(keys), kept, hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_dedup_query(spark):
    assert ordered(op7_exact_dedup(spark, SF).collect()) == ordered(brute_dedup(documents()))


def test_dedup_odd_rows(spark):
    want = ordered(brute_dedup([r[:2] for r in ODD]))
    assert ordered(exact_dedup.exact_dedup(odd(spark)).collect()) == want
    kept = exact_dedup.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == sum(r[3] for r in want)
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    assert exact_dedup.drop_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_compares_whole_texts(spark):
    """A digest of four values, so that most hits are different texts."""
    got = exact_dedup.exact_dedup(odd(spark), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1).isin(*"01234567").cast("string"))
    assert ordered(got.collect()) == ordered(brute_dedup([r[:2] for r in ODD]))


def test_dedup_stream_goes_on(spark):
    """New arrivals meet the state of the old ones."""
    from onset.llm.common import new_path

    arrivals, state = new_path(spark, "arrivals"), new_path(spark, "state")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "k long, digest string").select(F.struct("k").alias("doc"), "digest")
    first.write.parquet(arrivals)
    track = lambda: {r["digest"]: (r["n"], r["keep"]["key"]) for r in exact_dedup.track(spark, arrivals, state, first.schema, "k").collect()}
    assert track() == {"a": (1, 1), "b": (1, 2)}
    spark.createDataFrame([(9, "a"), (0, "b"), (3, "c")], "k long, digest string").select(F.struct("k").alias("doc"), "digest").write.mode("append").parquet(arrivals)
    assert track() == {"a": (2, 9), "b": (2, 2), "c": (1, 3)}
    assert track() == {"a": (2, 9), "b": (2, 2), "c": (1, 3)}


def test_license_query(spark):
    rows = op3_licenses(spark, SF)
    assert rows.count() == len(documents()) and rows.columns == ["doc_id", "digest", "license_id", "kind"]


def test_licenses_are_found_by_canonical_text(spark):
    name, kind, text = next(t for t in licenses.TEXTS if "\n" in t[2])
    marked = "Copyright (c) 2020 Somebody\n\n" + text.upper().replace("LICENSE", "LICENCE").replace(",", " ;")
    docs = spark.createDataFrame([(1, text), (2, marked), (3, text + " and more"), (4, None), (5, "©"), (1, text)], "doc_id long, text string")
    found = {(r["doc_id"], r["license_id"]) for r in licenses.license_scan(docs).collect()}
    assert found == {(1, name), (2, name), (3, None), (4, None), (5, None)}
    assert licenses.license_scan(docs).count() == 6
    assert licenses.license_scan(odd(spark)).count() == len(ODD)
    assert licenses.license_scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_wrapping_and_holders_make_no_difference(spark):
    texts = {name: text for name, _, text in reversed(licenses.TEXTS)}
    flat = lambda t: " ".join(t.split())
    wrapped = lambda t, n: "\n".join(textwrap.wrap(flat(t), n))
    mit, isc, bsd = (next(n for n in texts if n.startswith(x)) for x in ("MIT", "ISC", "BSD-3"))
    cases = [
        (isc, flat(texts[isc])), (isc, wrapped(texts[isc], 60)), ("MIT", wrapped(texts["MIT"], 50)), ("MIT", "Copyright (c) 2020 Bob. " + flat(texts["MIT"])), ("MIT", "MIT License\n\nCopyright 1999-2003 by A. Holder <a@b.org>\nCopyright © The Others\n\n" + texts["MIT"]),
        (bsd, "Copyright (C) 2011, Some Inc.\nAll rights reserved.\n\n" + wrapped(texts[bsd], 70)), (bsd, "(c) 2001 X\n" + texts[bsd].upper()), ("Unlicense", wrapped(texts["Unlicense"], 40)),
        (None, texts["MIT"] + "\n(c) You must keep this."), (None, texts["MIT"] + "\n(c) You may drop this."), (None, "Copyright (c) 2020 Bob"),
    ]
    cases = [(n, t) for n, t in cases if not t.startswith("MIT License")]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")).collect()}
    assert [got[i]["license_id"] for i in range(len(cases))] == [n for n, _ in cases]
    assert got[len(cases) - 3]["digest"] != got[len(cases) - 2]["digest"]  # clauses tell texts apart
    assert mit == "MIT"


@pytest.mark.parametrize("file", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0"])
def test_long_licences_are_known(spark, file):
    path = Path("/usr/share/common-licenses") / file
    if not path.exists():
        pytest.skip("no such text here")
    text = path.read_text(encoding="utf-8")
    docs = spark.createDataFrame([(1, text), (2, text.upper().replace("\n", "\r\n").replace(",", " ;")), (3, text.replace("the", "a", 1))], "doc_id long, text string")
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs).collect()}
    assert got[1] == got[2] and got[1].startswith(file.split("-")[0]) and got[3] is None


def test_license_query_against_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT doc_id, text FROM '{SF}/documents.parquet' UNION ALL BY NAME SELECT * FROM (VALUES (-1, NULL), (-2, 'Copyright (c) 2020 X' || chr(10) || {licenses._quoted(licenses.TEXTS[1][2])})) v(doc_id, text)")
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, "Copyright (c) 2020 X\n" + licenses.TEXTS[1][2])], "doc_id long, text string"))
    assert ordered(db.sql(licenses.scan_sql()).fetchall()) == ordered(licenses.license_and_notice_scan(rows).collect())


def test_notice_lines_are_part_of_the_scan(spark):
    notices = [t for t in licenses.TEXTS if "\n" not in t[2]]
    rows = [(i, f"Some words\n  {text.upper()} \nand more") for i, (_, _, text) in enumerate(notices)]
    rows += [(50, f"{notices[0][2]}\nx\n{notices[1][2]}\n{notices[0][2]}"), (51, f"x {notices[0][2]}"), (52, None), (53, notices[0][2]), (None, f"a\n{notices[0][2]}"), (0, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ordered((r["doc_id"], r["license_id"], r["kind"]) for r in licenses.license_and_notice_scan(docs).collect())
    want = [(i, name, "notice_line") for i, (name, _, _) in enumerate(notices)] + [(50, ",".join(sorted({notices[0][0], notices[1][0]})), "notice_line"), (51, None, None), (52, None, None)]
    assert got == ordered([*want, (53, notices[0][0], "notice"), (None, notices[0][0], "notice_line"), (0, None, None)])
    assert licenses.license_and_notice_scan(odd(spark)).count() == len(ODD)


def test_the_license_query_returns_the_notices_of_the_table(spark):
    sf = SF.replace("0.001", "0.1")
    found = licenses.notice_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    want = found.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("ids")).collect()
    got = op3_licenses(spark, sf).where("kind = 'notice_line'").select("doc_id", "license_id").collect()
    assert len(got) > 200 and ordered(got) == ordered(want)
    print(len(got))


def brute_url(url: str | None) -> tuple[str, str, str | None, str | None]:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = host.translate(_UPPER)
    best = None
    for says, rule in url_filters.RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = says, rule
    return host, path, best[1] if best else None, best[0] if best else None


def test_url_query(spark):
    urls = dict(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect())
    rows = op8_url_filters(spark, SF).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, says = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == says if says else r["verdict"] in ("allow", "block")


def brute_blocked(outcomes: list[tuple[str, int | None]], limit: float = 0.5, z: float = 1.645) -> set[str]:
    """Hosts whose lower posterior bound passes the limit, priors from suffix to host."""
    def prior(groups):
        seen = [(n, b) for n, b in groups if n]
        if not seen:
            return 2.0
        n, bad = sum(x for x, _ in seen), sum(x for _, x in seen)
        mean = min(max(bad / n, 1e-6), 1 - 1e-6)
        room = n - sum(x * x for x, _ in seen) / n
        if len(seen) < 2 or room <= 0:
            return 10.0
        over = (sum(b * b / x for x, b in seen) - n * mean * mean) / (mean * (1 - mean)) - (len(seen) - 1)
        rho = min(max(over / (room - (len(seen) - 1)) if room > len(seen) - 1 else 0.0, 1e-3), 0.5)
        return (1 - rho) / rho

    hosts: dict[str, list[int]] = {}
    for host, bad in outcomes:
        hosts.setdefault(host, []).extend([] if bad is None else [bad])
    level = lambda k: {g: (sum(len(hosts[h]) for h in hosts if k(h) == g), sum(sum(hosts[h]) for h in hosts if k(h) == g)) for g in {k(h) for h in hosts}}
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    s, d = level(suffix), level(domain)
    total, bad = sum(n for n, _ in s.values()), sum(b for _, b in s.values())
    ws, wd, wh = prior(s.values()), prior(d.values()), prior([(len(x), sum(x)) for x in hosts.values()])
    found = set()
    for host, seen in hosts.items():
        of_suffix = (s[suffix(host)][1] + (bad / total if total else 0.0) * ws) / (s[suffix(host)][0] + ws)
        of_domain = (d[domain(host)][1] + of_suffix * wd) / (d[domain(host)][0] + wd)
        mean = (sum(seen) + of_domain * wh) / (len(seen) + wh)
        if mean - z * (mean * (1 - mean) / (len(seen) + wh + 1)) ** 0.5 > limit:
            found.add(host)
    return found


def test_verdicts_of_hosts_against_brute_force_and_sql(spark):
    """Pages without a rule, of hosts of all rates and sizes; one has a third of all."""
    rng = random.Random(11)
    hosts = [("hot.a.com", 0.05, 900), ("worst.a.com", 0.98, 120), ("spam.b.io", 0.9, 300), ("half.b.io", 0.5, 200), ("two.c.io", 1.0, 2), *((f"h{i}.d{i % 5}.com", rng.random(), rng.randrange(1, 80)) for i in range(30))]
    rows = [(h, int(rng.random() < rate) if rng.random() < 0.8 else None) for h, rate, n in hosts for _ in range(n)]
    pages = [(i, f"https://{h}/x{i}") for i, (h, _) in enumerate(rows)]
    labels = [(i, 1 - b, 0) for i, (_, b) in enumerate(rows) if b is not None]
    want = brute_blocked(rows)
    assert {"worst.a.com", "spam.b.io"} <= want and not want & {"hot.a.com", "half.b.io"}
    got = url_filters.url_filters(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {r["host"] for r in got if r["verdict"] == "block"} == want
    db = duckdb.connect()
    db.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    db.executemany("INSERT INTO pages VALUES (?, ?)", pages)
    db.sql("CREATE TABLE labels (doc_id BIGINT, quality INTEGER, toxic INTEGER)")
    db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    assert ordered(db.sql(url_filters.filters_sql()).fetchall()) == ordered(got)


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?y#z", "http://net", "http://x.net/", "http://org/fr/é", "a://b.org?q=://c", "http://b.org#/fr/", "x://example.com/de/../", "http://fr.example.com:80/de/"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls + urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = url_filters.url_filters(pages, labels).collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        host, path, rule, says = brute_url((urls + urls)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, says or "allow")
    assert url_filters.url_filters(pages.limit(0), labels).count() == 0
    assert url_filters.url_filters(pages, labels.limit(0)).count() == len(rows)


@pytest.mark.parametrize("few", [100_000, 0])
def test_reputation_blocks_bad_hosts_and_shrinks_small_ones(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rows = [("bad.a.com", i % 20 != 0) for i in range(200)] + [("good.b.com", i % 20 == 0) for i in range(4000)] + [("once.c.com", True)] + [("quiet.d.com", None)]
    outcomes = spark.createDataFrame([(h, None if b is None else int(b)) for h, b in rows], "host string, bad int")
    found = {r["host"]: r for r in url_filters.reputation(outcomes).collect()}
    assert {h for h, r in found.items() if r["blocked"]} == {"bad.a.com"}
    assert found["once.c.com"]["mean"] < 1 and found["quiet.d.com"]["n"] == 0
