import math

import numpy as np

from recordloom.llm import quality as Q


def fixture(spark):
    good = "The quick brown fox %d jumps over a lazy dog near the old river bank in spring."
    bad = "BUY!! NOW!! BUY!! NOW!! %d $$$ ### BUY!! NOW!!"
    rows = [(n, (bad if n % 4 == 0 else good) % n, "src0" if n < 200 else f"src{n % 7}", ("en", "de")[n % 2]) for n in range(300)]
    labels = [(n, int(n % 4 > 0)) for n in range(300) if n % 3]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_posteriors_equal_a_plain_computation(spark):
    docs, labels = fixture(spark)
    rows = Q.score(docs, labels).collect()
    model = Q.fit_text_model(docs, labels)
    p = {r.doc_id: 1 / (1 + math.exp(-(r.evidence + model.prior))) for r in rows}
    mean = np.clip(np.mean(list(p.values())), 1e-3, 1 - 1e-3)
    sites, hosts = {}, {}
    for r in rows:
        sites.setdefault((r.host, r.path), []).append(p[r.doc_id])
        hosts.setdefault(r.host, []).append(p[r.doc_id])
    n, var = len(rows), mean * (1 - mean)
    far_host = sum(len(v) * (np.mean(v) - mean) ** 2 for v in hosts.values()) / n
    far_path = sum(len(v) * (np.mean(v) - np.mean(hosts[h])) ** 2 for (h, _), v in sites.items()) / n
    host_trust = Q.trust(n, len(hosts), mean, far_host, var / n * len(hosts))
    path_trust = Q.trust(n, len(sites), mean, far_path, var / n * (len(sites) - len(hosts)))
    for r in rows:
        own, host, path = p[r.doc_id], hosts[r.host], sites[r.host, r.path]
        of_host = (sum(host) - own + host_trust * mean) / (len(host) - 1 + host_trust)
        share = (sum(path) - own + path_trust * of_host) / (len(path) - 1 + path_trust)
        quality = 1 / (1 + math.exp(-(r.evidence + math.log(share / (1 - share)))))
        assert math.isclose(share, r.site_share, rel_tol=1e-6) and math.isclose(quality, r.quality, rel_tol=1e-6)
        assert r.keep == (r.doc_id % 4 > 0)


def test_sparse_sites_are_drawn_to_the_level_above():
    trusting, doubting = Q.trust(1e4, 20, 0.8, 1e-6, 1e-5), Q.trust(1e4, 20, 0.8, 0.1, 1e-5)
    assert trusting > 1e4 and doubting < 2
    assert Q.trust(0, 0, 0.5, 0.0, 0.0) == 1e6


def test_given_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = Q.score(docs, labels.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")).join(labels, "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").select("keep", labels["quality"].alias("y")).collect()
    assert sum(r.keep == (r.y == 1) for r in held) / len(held) > 0.95
    assert sum(r.keep for r in held if r.y) / sum(r.y for r in held) > 0.97


def test_odd_rows_and_missing_labels(spark, odd, none):
    docs, labels = fixture(spark)
    assert Q.score(odd, labels).count() == odd.count()
    assert Q.kept(odd, labels).columns == odd.columns
    assert Q.kept(odd, labels.where("false")).count() == odd.count()
    assert Q.score(none, labels).count() == 0
    marked = docs.selectExpr("*", "doc_id as _q_host", "'x' as _q_p", "2 as row")
    kept = Q.kept(marked, labels)
    assert kept.columns == marked.columns and kept.where("_q_host <> doc_id OR _q_p <> 'x' OR row <> 2").count() == 0 and kept.count() > 0
    assert Q.kept(none, labels.where("false")).columns == odd.columns
