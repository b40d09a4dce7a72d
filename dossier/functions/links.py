"""Link targets and the profile links among them."""

from pyspark.sql import functions as F

from dossier import constants as K


def link_targets(html):
    """All link targets of a page in page order, quoted or not, with the usual entities decoded."""
    written = F.regexp_extract_all(html, F.lit(K.HREF), F.lit(1))
    return F.filter(F.transform(written, _target), lambda u: u != "")


def _target(written):
    bare = F.btrim(F.btrim(written, F.lit("\"'")))
    for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return bare


def _last(urls, pattern):
    return F.try_element_at(F.filter(urls, lambda u: u.rlike(pattern)), F.lit(-1))


def linkedin_profile(urls):
    return _last(urls, K.LINKEDIN_PROFILE)


def github_profile(urls):
    """The last account page; a repository below an account does not count."""
    return _last(urls, K.GITHUB_PROFILE)


def mail_address(urls):
    return F.regexp_extract(_last(urls, K.MAILTO), K.MAILTO, 1)
