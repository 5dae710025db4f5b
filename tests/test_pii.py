"""Masks and counts of personal data, worked out by hand."""

import hashlib

from tessera.plans.registry import QUERIES

#: Text, what is left of it, and how many emails, phones, IP addresses, Aadhaar numbers and names it has.
MASKED = [
    ("call 98765 43210 or 9876543210", "call [PHONE] or [PHONE]", (0, 2, 0, 0, 0)),
    ("+91 98765-43210, +919876543210", "[PHONE], +919876543210", (0, 1, 0, 0, 0)),  # a digit before the ten digits
    ("x123456789012 98765432101", "x123456789012 98765432101", (0, 0, 0, 0, 0)),
    ("id 1234 5678 9012", "id [AADHAAR]", (0, 0, 0, 1, 0)),
    ("1234\t5678\n9012", "[AADHAAR]", (0, 0, 0, 1, 0)),
    ("Dr. Asha Rao, Sri  Ravi, Prof\nMeena Iyer, Mr É", "[NAME], [NAME], [NAME], Mr É", (0, 0, 0, 0, 3)),
    ("a.b+c@d-e.co.in é@x.fr", "[EMAIL] [EMAIL]", (2, 0, 0, 0, 0)),
    ("10.0.0.1 1.2.3.4.5", "[IP] [IP].5", (0, 0, 2, 0, 0)),
    ("९८७६५ ४३२१० १२३४ ५६७८ ९०१२", "[PHONE] [AADHAAR]", (0, 1, 0, 1, 0)),
    ("", "", (0, 0, 0, 0, 0)),
    ("plain", "plain", (0, 0, 0, 0, 0)),
    ("98765 43210 Smt. Asha", "[PHONE] [NAME]", (0, 1, 0, 0, 1)),
]


def test_masks(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(MASKED)] + [(99, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r[0]: tuple(r)[1:] for r in QUERIES["pii_mask"](spark, str(tmp_path)).collect()}
    assert len(out) == len(MASKED) + 1 and out[99][-1] is None
    for i, (text, left, counts) in enumerate(MASKED):
        assert out[i] == (*counts, hashlib.sha256(left.encode()).hexdigest()), text
