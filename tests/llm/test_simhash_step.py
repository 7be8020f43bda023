"""The near-dup stage finds near copies by SimHash fingerprints first, and bands of minima only add what these leave apart."""

import random

from runlens.llm import simhash


def test_near_groups_link_by_fingerprints_first(spark, monkeypatch):
    rnd, calls = random.Random(5), []
    plain = simhash.bucket_links

    def watched(members, near, verify, payload=None, *args, **kwargs):
        links = plain(members, near, verify, payload, *args, **kwargs)
        calls.append((payload.columns, links))
        return links

    monkeypatch.setattr(simhash, "bucket_links", watched)
    base = [f"w{rnd.randrange(9000)}" for _ in range(1500)]
    # one line said again and again makes the fingerprint, and half of the different words are others
    loud = lambda k: " ".join([*["one two three four"] * 400, *(f"{k}{i}" for i in range(60))])
    docs = [(1, " ".join(base)), (2, " ".join([*base[:700], "other", *base[701:]])), (3, " ".join(base[:1230])), (4, ""), (5, None), (6, loud("x")), (7, loud("y"))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7}
    (columns, by_fingerprint), (_, all_links) = calls
    fp = [simhash.majority(simhash.shingle_hashes(simhash.words_of(t), 3)) for _, t in docs[:3]]
    assert bin(fp[0] ^ fp[1]).count("1") <= 2 < bin(fp[0] ^ fp[2]).count("1")
    assert columns == ["node", "fp"] and by_fingerprint.distinct().count() == 1 and all_links.distinct().count() == 2
