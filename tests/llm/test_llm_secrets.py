"""Ownership: which values of the further shapes become spans, and what counts as live."""

from tessera.llm import secret_scan

TOKEN = "ghp_" + "a1B2" * 10
BLOCK = "-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----"


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    return {r.doc_id: [(s.kind, s.start, s.end, s.n_owners, s.n_repos) for s in r.spans] for r in secret_scan.secret_scan(df).collect()}


def test_one_and_two_owners_look_live_three_do_not(spark):
    rows = [(k, f"s{k % n}", f"see {t} here") for t, n, ks in ((TOKEN + "x", 1, range(4)), (TOKEN + "y", 2, range(4, 8)), (TOKEN + "z", 3, range(9, 15))) for k in ks]
    got = scanned(spark, rows)
    assert all(got[k] == [("key", 4, 4 + len(TOKEN) + 1, 1, 4)] for k in range(4))
    assert all(got[k] == [("key", 4, 4 + len(TOKEN) + 1, 2, 4)] for k in range(4, 8))
    assert all(got[k] == [] for k in range(9, 15))


def test_many_repositories_of_one_owner(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "EXAMPLE_REPOS", 5)
    got = scanned(spark, [(k, "s", TOKEN) for k in range(5)] + [(9, "s", TOKEN + "q"), (9, "s", TOKEN + "q")])
    assert all(got[k] == [] for k in range(5)) and got[9] == [("key", 0, len(TOKEN) + 1, 1, 1)]


def test_different_keys_have_different_owners(spark):
    rows = [(k, f"s{k}", BLOCK.format("MIIE" + str(k) * 20)) for k in range(5)] + [(9, "t", BLOCK[:31] + " and no end")]
    got = scanned(spark, rows)
    assert all(got[k] == [("key", 0, len(BLOCK) - 2 + 24, 1, 1)] for k in range(5)) and got[9] == []


def test_base_spans_stay_however_many_hold_them(spark):
    got = scanned(spark, [(k, f"s{k}", "password = hunter2") for k in range(6)] + [(None, None, "password = hunter2"), (7, None, None)])
    assert all(got[k] == [("assign", 0, 18, 7, 7)] for k in [*range(6), None]) and got[7] == []


def test_key_blocks_of_any_content(spark):
    pgp = "-----BEGIN PGP PRIVATE KEY BLOCK-----\nComment: host-a-b-c-d-e-f-g-h-i-j-k-l-m-n\n\nlQOYBF\n=aB1\n-----END PGP PRIVATE KEY BLOCK-----"
    dashed = BLOCK.format("Comment: " + "-".join("abcdefghijklmnop") + "\n" + "- -- ----- x\n" * 300)
    many = BLOCK[:31] * 3_000
    got = scanned(spark, [(1, "a", pgp), (2, "b", "é " + dashed + " tail " + pgp), (3, "c", many + "\n" + BLOCK[-29:])])
    assert got[1] == [("key", 0, len(pgp), 2, 2)]
    assert got[2] == [("key", 2, 2 + len(dashed), 1, 1), ("key", 8 + len(dashed), 8 + len(dashed) + len(pgp), 2, 2)]
    assert got[3] == [("key", len(many) - 31, len(many) + 30, 1, 1)]
