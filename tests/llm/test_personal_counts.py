"""The counts of the personal data query, beside plain Python."""
import hashlib

from dipsift.llm import queries
from dipsift.llm.ship import ship


def test_counts_are_by_kind_whatever_the_order(spark, tmp_path):
    ship(spark)
    texts = ["a@b.c d@e.f 1.2.3.4", "1.2.3.4 a@b.c 5.6.7.8", "4111111111111111 +1 555 123 4567 a@b.c", "a@b.c " * 600, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op3_personal_data"](spark, str(tmp_path)).collect()}
    want = [(2, 1, 0, 0), (1, 2, 0, 0), (1, 0, 1, 1), (600, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(len(texts))] == want
    assert got[1].base_sha256 == hashlib.sha256(b"ip:0:7,email:8:13,ip:14:21").hexdigest()
