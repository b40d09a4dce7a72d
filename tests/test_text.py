from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import durations, links, text as X


def one(spark, value, expression, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expression(F.col("x"))).first()[0]


def test_white_space_is_unicode(spark):
    assert set(K.WHITESPACE) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    odd = "  a b\x1cc　"
    assert one(spark, odd, X.strip) == odd.strip()
    assert one(spark, odd, X.drop_stop_words) == "b c"


def test_stop_words(spark):
    assert len(set(K.STOP_WORDS)) == 198
    text = "The  quick\n\nand, the you've\tFOX is"
    want = " ".join(w for w in text.lower().split() if w not in set(K.STOP_WORDS))
    assert one(spark, text, X.clean) == want == "quick and, fox"
    assert one(spark, "  \n ", X.clean) == ""
    assert one(spark, None, X.clean) is None


def test_first_email(spark):
    assert one(spark, "mail a.b+c@x-y.co.uk or z@z.com", X.first_email) == "a.b+c@x-y.co.uk"
    assert one(spark, "no @ here a@b", X.first_email) is None
    assert one(spark, "(x@@y.com) q!w@e.org", X.first_email) == "w@e.org"
    # linear on a long unbroken run that never gets to be an address
    assert one(spark, "a" * 300_000 + " @", X.first_email) is None


def test_first_mobile(spark):
    assert one(spark, "x 129876543210 y", X.first_mobile) == "9876543210"
    assert one(spark, "+91-9876543210.", X.first_mobile) == "9876543210"
    assert one(spark, "98765432101", X.first_mobile) == "8765432101"
    assert one(spark, "5876543210", X.first_mobile) is None
    assert one(spark, "9876543210x", X.first_mobile) is None


def test_repair_mobile(spark):
    cases = {
        "+91-9876543210": "+91 9876543210",
        "98765 43210": "9876543210",
        "5876543210": None,
        "12345": None,
        "987654321099": "9876543210",
        "1234567890123456": None,
        "": None,
        None: None,
    }
    for given, want in cases.items():
        assert one(spark, given, X.repair_mobile) == want, given


def test_validity(spark):
    for given, want in {"a@b.c": True, "a@b": False, " a@b.c": False, "a@b.c\n": True, "a@b.c\r": False, None: False}.items():
        assert one(spark, given, X.is_email) is want, given
    for given, want in {"+919876543210": True, "9876543210": True, "919876543210": False, "1-2-3": False, None: False}.items():
        assert one(spark, given, X.is_mobile) is want, given


def test_profile_links(spark):
    urls = [
        "https://github.com/first",
        "https://github.com/last/",
        "https://github.com/last/repository",
        "https://www.linkedin.com/in/ann-b/details",
        "linkedin.com/company/x",
        "mailto:a.b@c.org?subject=x",
    ]
    row = spark.createDataFrame([(urls,), ([],), (None,)], "u array<string>")
    got = row.select(links.github_profile(F.col("u")), links.linkedin_profile(F.col("u")), links.mail_address(F.col("u"))).collect()
    assert tuple(got[0]) == ("https://github.com/last/", "https://www.linkedin.com/in/ann-b/details", "a.b@c.org")
    assert tuple(got[1]) == tuple(got[2]) == (None, None, None)


def test_link_targets(spark):
    html = """<a href="/a">x</a><A class=b href = '/b?x=1'>y</A><a name="c">"""
    assert one(spark, html, links.link_targets) == ["/a", "/b?x=1"]


def test_years_and_months(spark):
    cases = {
        None: "0 months", 0.0: "0 months", 0.99: "12 months", 1.0: "1 year", 1.99: "1 year 12 months", 2.5: "2 years 6 months",
        2.5 / 12: "2 months", 3.5 / 12: "4 months", 1 / 12: "1 month", -1.5: "-6 months", 1 + 1 / 12: "1 year 1 month",
    }
    for given, want in cases.items():
        assert one(spark, given, durations.years_and_months, "double") == want, given
