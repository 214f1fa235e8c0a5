"""Fixed values of the form domain: they must be as they are for right results."""

from __future__ import annotations

# Label patterns in order; the first that matches a lower-case label gives its type.
TYPE_RULES = [
    (r"\biban\b|direct debit a/?c|repayment a/?c", "iban"),
    (r"\bcnic\b|\bid\s*no\b|\bid\s*number\b|\bsnic\b|\bnicop\b", "cnic"),
    (r"passport", "passport"),
    (r"\bntn\b", "ntn"),
    (r"e-?mail", "email"),
    (r"mobile|\bcell\b|cellular", "mobile"),
    (r"landline|tel\.?\s*no|telephone|phone", "phone"),
    (r"date\b|\bsince\b|year of manufacture", "date"),
    (r"amount|income|\bpkr\b|turnover|\blimit\b|price|value|deposit|salary|outstanding", "amount"),
    (r"no\.? of transactions|number of dependents|term of loan|work experience|\bmonths\b|\byears\b", "integer"),
    (r"post/?zip|zip code", "postcode"),
    (r"branch code|customer number|p\.?a\.?\s*no|personnel id|\bcode\b|\bp\.?\s*no\b", "digits"),
    (r"a/?c no|account no|card no", "account"),
    (r"house|appt|apartment|\bflat\b|\bplot\b|street|\broad\b|address|building|\bfloor\b|\bblock\b|sector|village|mohallah?|landmark|\btown\b|office no", "text"),
    (r"name", "name"),
]

# Fixed value: labels that ask for a description are text, whatever else they mention.
DESCRIPTIVE = r"please specify|\(specify\)|- other|\bnature\b|industry|line of business|source of income|source of wealth|\bdetails\b|description|work experience"

# Types whose letters may be read as digits, and types that the character reader reads.
NUMERIC_TYPES = ["date", "cnic", "ntn", "phone", "mobile", "amount", "integer", "postcode", "digits", "account"]
READER_TYPES = [*NUMERIC_TYPES, "iban", "passport"]

# What stands for nothing.
SENTINELS = ["", "empty"]
NONE_MARKERS = ["none", "n/a", "na", "-", "--", "nil", "null", "no"]
CORE_TRIM = " _*:.–-"
LEAD_TRIM = " _*|=–—-"

# Letter shapes and the digits they are read as.
LETTERS, DIGITS = "OoQDIl|iSsBZGbTA", "0000111155826674"

# The bank code of the form's own accounts, and area codes; two cities have eight-digit numbers.
BANK_CODE = "HABB"
LONG_AREAS = ["021", "042"]
AREAS = {
    "021": "Karachi", "022": "Hyderabad", "025": "Dadu", "028": "Nawabshah", "040": "Sahiwal", "041": "Faisalabad",
    "042": "Lahore", "044": "Okara", "045": "Kasur", "046": "Toba Tek Singh", "047": "Jhang", "048": "Sargodha",
    "049": "Sheikhupura", "051": "Islamabad/Rawalpindi", "052": "Sialkot", "053": "Gujrat", "055": "Gujranwala",
    "056": "Sheikhupura", "057": "Attock", "061": "Multan", "062": "Bahawalpur", "063": "Vehari", "064": "Layyah",
    "065": "Muzaffargarh", "066": "Dera Ghazi Khan", "067": "Khanewal", "068": "Rahim Yar Khan", "071": "Sukkur",
    "074": "Larkana", "081": "Quetta", "091": "Peshawar", "092": "Mardan", "094": "Kohat", "095": "Bannu",
    "0992": "Abbottabad", "0997": "Haripur", "0946": "Swat",
}

# Thresholds of tick boxes, ink and page alignment.
TICK_ON, TICK_SHARE, TICK_SURE = 0.030, 0.55, 0.75
INK_TRACE, INK_SURE, INK_TIMES, INK_FAINT, INK_FAINT_SHARE = 500, 4000, 3, 60, 0.06
MIN_INLIERS, MIN_COVERAGE, MAX_OFFSET = 25, 0.80, 4.0

# How a reading's source is named in a record.
SOURCE_NAMES = {"page": "vlm-page", "ocr-sweep": "ocr-verified", "retry": "vlm-recheck", "ink-gate": "ink-gate", "batch": "vlm-batch", "single": "vlm-single", "with-parent": "read-with-parent"}

# Labels of blanks by the printed text that leads to them.
BLANK_LABELS = [
    (r"holder\s+of\s+cnic$", "Undertaking - CNIC"),
    (r"s/o,?\s*d/o,?\s*w/o$", "Undertaking - Father's/Husband's Name"),
    (r"\bas\s+on$", "Undertaking - As on Date"),
    (r"^i$", "Undertaking - Name of Applicant"),
]

# The sentences that checks across fields give; %s is what was found.
ISSUES = {
    "expiry": "Date of Expiry is not after Date of Issue",
    "birth": "Date of Birth is not before Date of Issue",
    "year": "Date of Birth year %s looks implausible",
    "gender": "CNIC ends in %s, which means %s, but Gender is ticked %s",
    "title": "Title of Account '%s' matches neither First nor Last name",
}
LAST_BIRTH_YEAR = 2015

# The columns of a CSV result, in order, and the section of fields without one.
CSV_COLUMNS = ["page", "section", "group", "label", "kind", "type", "value", "raw", "source", "model", "confidence", "valid", "needs_review", "note", "field"]
NO_SECTION = "(unsectioned)"
