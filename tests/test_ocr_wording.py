"""The OCR note in the wording of findings."""

from conftest import SF

import __spark_entry__ as entry


def test_stubs_read_by_ocr_carry_the_note(spark):
    rows = entry.queries()["f14_ocr_stub_finding_text"](spark, SF).collect()
    plain = entry.queries()["f14_stub_finding_text"](spark, SF).collect()
    noted = [r for r in rows if r.what.endswith("Read by OCR, so a misread digit is possible; compare the marked figures.")]
    assert noted and len(noted) + len(plain) == len(rows)
