import hashlib
import json

from pyspark.sql import functions as F

from fleetsight.functions import dates as D
from fleetsight.functions import keys as H
from fleetsight.functions import redact as R
from fleetsight.functions import text as T
from fleetsight.functions import urls as U


def one(spark, **columns):
    """Evaluate expressions on one row."""
    return spark.range(1).select(*[value.alias(name) for name, value in columns.items()]).first().asDict()


def test_text_normalisation_and_identifiers(spark):
    row = one(
        spark,
        blanks=T.normalize_text(F.lit("  A B\t\nC  ")),
        cve=T.extract_cve(F.lit("see cve-2024-12345.")),
        inside=T.extract_cve(F.lit("xCVE-2024-12345")),
        hint=T.infer_component(F.lit("a vulnerable gateway")),
        surface=T.infer_surface(F.lit("cloud application")),
        component=T.infer_component(F.lit("cloud application")),
        markup=T.strip_markup(F.lit("<b>A</b>&amp;&nbsp;<i>B</i> &eacute;")),
        level=T.risk_level_from_severity(F.lit("unknown")),
    )
    assert row == {
        "blanks": "a b c", "cve": "CVE-2024-12345", "inside": None, "hint": "bluetooth", "surface": "cloud_api",
        "component": "app", "markup": "A & B é", "level": "info",
    }


def test_hash_equals_escaped_canonical_json(spark):
    for text in ("plain", 'quote " and \\', "日本語", "emoji 😀", "é "):
        expected = hashlib.sha256(json.dumps({"url": text}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert one(spark, h=H.stable_hash({"url": F.lit(text)}))["h"] == expected


def test_urls(spark):
    row = one(
        spark,
        canonical=U.canonical_url(F.lit(" HTTPS://Host.Test#frag ")),
        other=U.canonical_url(F.lit("manual://Entry#x")),
        safe=U.safe_url(F.lit("https://u:p@Host.test:8443/a?token=1&q=a%20b&x=password%3A1#secret=1")),
        up=U.absolute_url(F.lit("https://h.test/a/b/c.html"), F.lit("../../d")),
        mail=U.absolute_url(F.lit("https://h.test/"), F.lit("mailto:a@b.test")),
    )
    assert row == {
        "canonical": "https://host.test/", "other": "manual://Entry#x", "safe": "https://host.test:8443/a?q=a+b",
        "up": "https://h.test/d", "mail": "mailto:a@b.test",
    }


def test_redaction(spark):
    row = one(
        spark,
        hit=R.looks_sensitive(F.lit("api-key = abc")),
        miss=R.looks_sensitive(F.lit("mypassword: x")),
        error=R.sanitize_error(F.lit("call token=abc&x=1 with secret")),
        name=R.is_sensitive_name(F.lit("X-Api-Key")),
    )
    assert row == {"hit": True, "miss": False, "error": "call [redacted]=[redacted]&x=1 with [redacted]", "name": True}


def test_level_boundaries(spark):
    expected = {90.0: "critical", 89.99: "high", 70.0: "high", 69.99: "medium", 40.0: "medium", 39.99: "low"}
    for score, level in expected.items():
        assert one(spark, level=D.risk_level_for_score(F.lit(score)))["level"] == level


def test_times(spark):
    texts = ["2026-01-01T00:00:00.000", "Mon, 05 Jan 2026 10:00:00 GMT", "01/02/2026", "2026/1/2", "soon"]
    got = [one(spark, t=D.iso_utc(D.parse_when(F.lit(text))))["t"] for text in texts]
    assert got == ["2026-01-01T00:00:00Z", "2026-01-05T10:00:00Z", "2026-01-02T00:00:00Z", "2026-01-02T00:00:00Z", None]
