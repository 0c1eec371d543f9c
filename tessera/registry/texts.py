"""Queries of text, name, address and script functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, names, scripts, text
from ..operators import reports
from ..plans.normalize import learn_token_map, normalize
from ..storage import spread
from .base import RECORDS, query, records, sql_values, table, values

NAMES = [
    (1, "The Acme Pvt. Ltd.", "india"), (2, "Müller & Söhne GmbH", "de"), (3, "S.A.R.L. Dupont", "france"), (4, "Dupont S.A.R.L.", "france"),
    (5, "Limited", "us"), (6, "Acme Limited Liability Company", "us"), (7, "Ltd Ltd Corp", None), (8, None, "us"), (9, "  ", "france"),
    (10, "SASU Le Pain", "France"), (11, "Le Pain L.L.C.", "US"), (12, "Incorporated Things", "us"), (13, "One Person Company Tea", "india"),
    (14, "Tea One Person Company", "india"), (15, "sa", "france"), (16, "X Public Limited Company", "uk"), (17, "Company of Heroes plc", "uk"), (18, "A&B Inc", "us"),
]
ADDRESSES = [
    (1, "12 Main St, Springfield, IL 62701", "us"), (2, "Plot No. 7, MG Road, Pune 411001", "india"), (3, "H.No 16-2-851/B, Saidabad, Hyderabad, Telangana", "india"),
    (4, "14 R. de la Paix, 75002 Paris", "france"), (5, "3 bis CH. des Prés, 69001LYON CEDEX", "france"), (6, "Zone Nord, 00123, Lille", "france"),
    (7, "Postcode: SW1A 1AA, London", "uk"), (8, "5th Flr, Tower FL 33101", "us"), (9, None, "us"), (10, "", "france"), (11, "Apt 4, 221 Baker St, London", None),
    (12, "45000 rue Royale, Orleans", "france"), (13, "Shop 3, Delhi", "india"), (14, "pin code: 560001, Bangalore, Karnataka", "india"), (15, "A-301, Sunrise Bldg, Mumbai, Maharashtra, null", "india"),
    (16, "zip 90210-1234, Beverly Hills, CA 90210", "us"), (17, "12 St Ave, Ste-Foy, Québec", "canada"), (18, "10 bd Victor, St Étienne", "france"), (19, "99 Ln, 123456 City", "nowhere"),
]


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), '&', ' and '), '[^\\p{L}\\p{M}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM documents""")
def clean_text_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.clean_text("text").alias("clean"))


@query("SELECT doc_id, replace(replace(strip_accents(text), 'œ', 'oe'), 'æ', 'ae') AS plain FROM documents")
def strip_accents_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.strip_accents("text").alias("plain"))


@query("SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS plain FROM documents")
def plain_text_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.plain_text("text").alias("plain"))


@query(f"""WITH {RECORDS}, p AS (SELECT entity_id, trim(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS n,
  trim(regexp_replace(lower(address), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS a FROM records) SELECT entity_id, trim(n || ' ' || a) AS query_text FROM p""")
def retrieval_text_records(spark, sf_dir):
    return records(spark, sf_dir).select("entity_id", text.retrieval_text("name", "address").alias("query_text"))


_LOOKALIKES = (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("7", "t"), ("8", "b"), ("@", "a"), (r"\$", "s"))


def _block_sql(c: str) -> str:
    s = f"lower(regexp_replace({c}, '[\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{ad}}]', '', 'g'))"
    s = f"regexp_replace({s}, 'https?://|www\\.', ' ', 'g')"
    s = f"regexp_replace({s}, '\\.(com|net|org|in|co|biz|info|us|fr)\\b', ' ', 'g')"
    s = f"strip_accents({s})"
    s = f"regexp_replace({s}, '(\\d)(st|nd|rd|th)\\b', '\\1', 'g')"
    for sign, letter in _LOOKALIKES:
        s = f"regexp_replace({s}, '([a-z]){sign}([a-z])', '\\1{letter}\\2', 'g')"
        s = f"regexp_replace({s}, '(^|[^\\p{{L}}\\p{{N}}]){sign}([a-z]{{2,}})', '\\1{letter}\\2', 'g')"
    return f"trim(regexp_replace(regexp_replace({s}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g'), '\\b0+(\\d)', '\\1', 'g'))"


@query(f"SELECT doc_id, {_block_sql('text')} AS clean FROM documents")
def block_text_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.block_text("text").alias("clean"))


@query(f"SELECT page_id, {_block_sql('url')} AS clean FROM pages")
def block_text_urls(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", text.block_text("url").alias("clean"))


HOUSE_SQL = r"(?:\b[a-z]{1,3}\s?[-#.]?\s?)?\d+(?:\s?[/\-]\s?[a-z0-9]+)+|\b[a-z]{1,3}\s?-\s?\d+[a-z]?\b"


@query(
    f"""SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(url), '{HOUSE_SQL}'),
  lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '[/\\-#.]+', '_', 'g'), '(^|_|[a-z])0+(\\d)', '\\1\\2', 'g')))), ' ') AS tokens FROM pages"""
)
def house_tokens_urls(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages")).select("page_id", text.house_tokens("url").alias("tokens"))


@query(
    f"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '\\b({text.JOINED_WITHOUT})\\b', ' ', 'g'), '\\s+', '', 'g') AS joined FROM part"""
)
def joined_part_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.joined_name(F.lower("p_name")).alias("joined"))


@query("""SELECT p_partkey, array_to_string(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substring(p_name, i, 3)), ' ') AS grams FROM part""")
def char_trigrams_parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.char_trigrams("p_name").alias("grams"))


@query(
    f"""WITH c AS (SELECT page_id, {_block_sql("split_part(split_part(url, '://', 2), '/', 1)")} AS n FROM pages)
SELECT page_id, n AS name, len(string_split(n, ' ')) = 1 AND length(regexp_replace(regexp_replace(n, '\\b({text.JOINED_WITHOUT})\\b', ' ', 'g'), '\\s+', '', 'g')) >= 8 AS domain_like FROM c"""
)
def domain_like_pages(spark, sf_dir):
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    d = spread(table(spark, sf_dir, "pages")).select("page_id", text.block_text(host).alias("name"))
    return d.withColumn("domain_like", text.domain_like("name"))


@query("""SELECT c_custkey, trim(lower(c_mktsegment) || ' ' || array_to_string(regexp_extract_all(c_name, '\\d+'), ' ')) AS name_numbers FROM customer""")
def name_numbers_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.name_numbers(F.lower("c_mktsegment"), "c_name").alias("name_numbers"))


def _skeleton_sql(c: str) -> str:
    """Letters by place: vowels after the first letter go, then an h after a consonant, then repeats."""
    sounds = "t"
    for spelling, sound in (("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("v", "w"), ("z", "s"), ("x", "ks")):
        sounds = f"replace({sounds}, '{spelling}', '{sound}')"
    vowel = "('a', 'e', 'i', 'o', 'u', 'y')"
    kept = f"list_transform(list_filter(range(1, len(c) + 1), lambda i: i = 1 OR NOT (c[i] IN {vowel} OR (c[i] = 'h' AND c[i - 1] NOT IN {vowel}))), lambda i: c[i])"
    once = "list_transform(list_filter(range(1, len(k) + 1), lambda i: i = 1 OR k[i] <> k[i - 1]), lambda i: k[i])"
    key = f"array_to_string(list_transform([list_transform([string_split({sounds}, '')], lambda c: {kept})[1]], lambda k: {once})[1], '')"
    return f"trim(regexp_replace(array_to_string(list_transform(string_split({c}, ' '), lambda t: CASE WHEN regexp_matches(t, '\\d') THEN t ELSE {key} END), ' '), '\\s+', ' ', 'g'))"


#: Views of records for all blocks, for texts of Latin letters (others are romanised, which is not in SQL).
_WITHOUT = (
    "private|limited|pvt|ltd|llc|l l c|llp|inc|incorporated|corp|corporation|co|company|plc|group|enterprises|services|sarl|sas|sasu|sa|eurl|sci|snc|and|et|of|the|de|la|le|les|des|du|m s|mr|mrs|dr|shri|sri|smt"
)
_JOIN_SQL = f"regexp_replace(regexp_replace(name, '\\b({_WITHOUT})\\b', ' ', 'g'), '\\s+', '', 'g')"
_HOUSE_SQL = r"""array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower(coalesce(address, '')), '(?:\b[a-z]{1,3}\s?[-#.]?\s?)?\d+(?:\s?[/\-]\s?[a-z0-9]+)+|\b[a-z]{1,3}\s?-\s?\d+[a-z]?\b'),
  lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', '', 'g'), '[/\-#.]+', '_', 'g'), '(^|_|[a-z])0+(\d)', '\1\2', 'g')))), ' ')"""
BLOCK_VIEWS = f"""v0 AS MATERIALIZED (SELECT entity_id, country, {_block_sql("coalesce(name, '')")} AS name, {_block_sql("coalesce(address, '')")} AS addr, regexp_matches(coalesce(name, ''), '[^\\P{{L}}\\p{{Latin}}]') AS nonlatin, {_HOUSE_SQL} AS house FROM records),
v1 AS MATERIALIZED (SELECT *, trim(concat_ws(' ', name, addr)) AS text, {_JOIN_SQL} AS joined FROM v0),
prepared AS MATERIALIZED (SELECT entity_id, country, name, addr, nonlatin, text, addr = '' AS addr_empty, trim(name || ' ' || array_to_string(regexp_extract_all(addr, '\\d+'), ' ')) AS namenum, {_skeleton_sql("name")} AS skel_name, {_skeleton_sql("text")} AS skel,
 array_to_string(list_transform(range(1, greatest(length(joined) - 2, 1) + 1), lambda i: substring(joined, i, 3)), ' ') AS concat3, len(string_split(name, ' ')) = 1 AND length(joined) >= 8 AS domainlike, trim(name || ' ' || house) AS namehouse FROM v1)"""


@query(f"WITH d AS MATERIALIZED (SELECT doc_id, {_block_sql('text')} AS clean FROM documents) SELECT doc_id, {_skeleton_sql('clean')} AS skeleton FROM d")
def skeleton_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", text.skeleton(text.block_text("text")).alias("skeleton"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{Devanagari}') THEN 'devanagari' WHEN regexp_matches(text, '[^\\P{L}\\p{Latin}]') THEN 'other' ELSE 'latin' END AS script FROM documents""")
def script_class_docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents")).select("doc_id", scripts.script("text").alias("script"))


SCRIPTS = [(1, "Café 12"), (2, "राम traders"), (3, "தமிழ்"), (4, None), (5, "12 34"), (6, "Ελλάδα"), (7, "क़मर ट्रेडर्स लिमिटेड"), (8, "মেসার্স রহমান"), (9, "ఎస్‌ఎస్ motors")]


@query(
    f"""WITH {sql_values(SCRIPTS, "v", "id, name")} SELECT CAST(id AS INTEGER) AS id, CASE WHEN regexp_matches(coalesce(name, ''), '\\p{{Devanagari}}') THEN 'devanagari'
 WHEN regexp_matches(coalesce(name, ''), '[^\\P{{L}}\\p{{Latin}}]') THEN 'other' ELSE 'latin' END AS script FROM v"""
)
def script_class_names(spark, sf_dir):
    return values(spark, SCRIPTS, "id int, name string").select("id", scripts.script("name").alias("script"))


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


#: The oracle's own copy of the fixed values of Indic letters, in the order of the block.
_CONSONANT_LIST = "क k ख kh ग g घ gh ङ ng च ch छ chh ज j झ jh ञ ny ट t ठ th ड d ढ dh ण n त t थ th द d ध dh न n \u0929 n प p फ ph ब b भ bh म m य y र r \u0931 r ल l ळ l \u0934 l व v श sh ष sh स s ह h \u0958 q \u0959 kh \u095a gh \u095b z \u095c r \u095d rh \u095e f \u095f y"
_SIGN_LIST = "ा aa ि i ी ee ु u ू oo ृ ri ॄ ri ॅ e ॆ e े e ै ai ॉ o ॊ o ो o ौ au \u0957 au"
_OTHER_LIST = "ँ n ं n ः h अ a आ aa इ i ई ee उ u ऊ oo ऋ ri ऎ e ए e ऐ ai ऑ o ऒ o ओ o औ au ऍ e ० 0 १ 1 २ 2 ३ 3 ४ 4 ५ 5 ६ 6 ७ 7 ८ 8 ९ 9"


def _map_sql(pairs: str, without: str = "") -> str:
    x = pairs.split()
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in zip(x[::2], x[1::2], strict=True) if k not in without) + "}"


def _letters_sql(letters: str, one: str) -> str:
    """A text rebuilt letter by letter: `one` on c (the letters), i (the place)."""
    return f"array_to_string(list_transform([string_split({letters}, '')], lambda c: list_transform(range(1, len(c) + 1), lambda i: {one}))[1], '')"


def _indic_sql(t: str) -> str:
    """Any of nine scripts, folded to one block without its dots."""
    fold = f"replace({_letters_sql(t, 'CASE WHEN ord(c[i]) BETWEEN 2432 AND 3455 THEN chr(CAST(2304 + (ord(c[i]) - 2304) % 128 AS INTEGER)) ELSE c[i] END')}, '\u093c', '')"
    con, sign, other = _map_sql(_CONSONANT_LIST), _map_sql(_SIGN_LIST), _map_sql(_OTHER_LIST)
    after = f"coalesce(ord(c[i + 1]) BETWEEN 2304 AND 2431 AND {sign}[c[i + 1]] IS NULL AND c[i + 1] NOT IN ('\u094d', 'ँ', 'ं', 'ः'), false)"
    one = f"CASE WHEN {con}[c[i]] IS NOT NULL THEN {con}[c[i]] || CASE WHEN {after} THEN 'a' ELSE '' END WHEN {sign}[c[i]] IS NOT NULL THEN CASE WHEN i > 1 AND {con}[c[i - 1]] IS NOT NULL THEN {sign}[c[i]] ELSE '' END WHEN ord(c[i]) BETWEEN 2304 AND 2431 THEN coalesce({other}[c[i]], '') ELSE c[i] END"
    return _letters_sql(fold, one)


def _devanagari_sql(t: str) -> str:
    """A token of a name in Devanagari."""
    unused = "\u0929\u0931\u0934\u095fऎऒ\u0957"
    con, sign, other = (_map_sql(x, unused) for x in (_CONSONANT_LIST, _SIGN_LIST, _OTHER_LIST))
    dots = f"regexp_replace({t}, '([क-नप-रलळव-ह\u0958-\u095e])\u093c', '\\1', 'g')"
    after = f"i < len(c) AND {sign}[c[i + 1]] IS NULL AND c[i + 1] <> '\u094d'"
    one = f"CASE WHEN {con}[c[i]] IS NOT NULL THEN {con}[c[i]] || CASE WHEN {after} THEN 'a' ELSE '' END WHEN {sign}[c[i]] IS NOT NULL THEN CASE WHEN i > 1 AND {con}[c[i - 1]] IS NOT NULL THEN {sign}[c[i]] ELSE 'x' END WHEN c[i] IN ('\u093c', '\u094d', 'ऽ') THEN '' WHEN ord(c[i]) BETWEEN 2304 AND 2431 THEN coalesce({other}[c[i]], 'x') ELSE strip_accents(c[i]) END"
    return f"lower({_letters_sql(dots, one)})"


def _latin_sql(c: str) -> str:
    """A cleaned core in Latin letters, less a legal form at its end."""
    token = f"CASE WHEN regexp_matches(t, '[\\x{{900}}-\\x{{97f}}]') THEN {_devanagari_sql('t')} ELSE regexp_replace(CASE WHEN regexp_matches(t, '[\\p{{Latin}}\\p{{Greek}}]') THEN strip_accents(t) ELSE t END, '\\p{{Mn}}', '', 'g') END"
    forms = "|".join(("private limited", "limited liability company", "limited", "company", "corporation", "incorporated"))
    return f"regexp_replace(array_to_string(list_transform(list_filter(string_split({c}, ' '), lambda t: t <> ''), lambda t: {token}), ' '), '^(.+?) (?:{forms})$', '\\1')"


@query(f"WITH {sql_values(SCRIPTS, 'v', 'id, name')}, n AS (SELECT CAST(id AS INTEGER) AS id, {_clean_sql('nfc_normalize(name)')} AS c FROM v) SELECT id, {_latin_sql('c')} AS latin FROM n")
def transliterate_names(spark, sf_dir):
    d = values(spark, SCRIPTS, "id int, name string")
    return d.select("id", scripts.transliterate(text.clean_text("name")).alias("latin"))


_LATINIZED = f"CASE WHEN regexp_matches(t, '[^\\P{{L}}\\p{{Latin}}]') THEN {_indic_sql('t')} ELSE strip_accents(t) END"


@query(
    f"""WITH {sql_values(SCRIPTS, 'v', 'id, name')}, n AS (SELECT CAST(id AS INTEGER) AS id, trim(regexp_replace(lower(regexp_replace(nfc_normalize(coalesce(name, '')), '[\\x{{200b}}-\\x{{200d}}]', '', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')) AS c FROM v)
SELECT id, array_to_string(list_transform(list_filter(string_split(c, ' '), lambda t: t <> ''), lambda t: {_LATINIZED}), ' ') AS name FROM n"""
)
def latinize_names(spark, sf_dir):
    d = values(spark, SCRIPTS, "id int, name string").select("id", text.block_text("name").alias("name"))
    return scripts.latinize(d, "name")


def _expand_sql(c: str, mapping: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda t: CASE t {cases} ELSE t END), ' ')"


def _dotted_sql(c: str) -> str:
    for spaced in names.DOTTED:
        c = f"regexp_replace({c}, '(^| ){spaced}($| )', '\\1{spaced.replace(' ', '')}\\2', 'g')"
    return c


NAME_SQL = _dotted_sql(_expand_sql(_clean_sql("name"), names.NAME_SHORT))


@query(f"WITH {sql_values(NAMES, 'v', 'id, name, country')} SELECT CAST(id AS INTEGER) AS id, {NAME_SQL} AS name_norm FROM v")
def normalize_names(spark, sf_dir):
    return values(spark, NAMES, "id int, name string, country string").select("id", names.normalize_name("name").alias("name_norm"))


_FORMS = "|".join(f.replace(" ", "\\s+") for f in names.LEGAL_FORMS)
_CALLED = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.LEGAL_FORMS.items())
_LEAD = "|".join(names.LEADING_FORMS)


@query(
    f"""WITH {sql_values(NAMES, "v", "id, name, country")}, n AS (SELECT id, lower(coalesce(country, '')) = 'france' AS fr, {NAME_SQL} AS n FROM v),
s AS (SELECT *, CASE regexp_extract(n, '^.+?\\s+({_FORMS})$', 1) WHEN '' THEN NULL {_CALLED} END AS form, nullif(regexp_extract(n, '^({_LEAD})\\s+.+$', 1), '') AS lead FROM n)
SELECT CAST(id AS INTEGER) AS id, CASE WHEN fr AND form IS NULL AND lead IS NOT NULL THEN regexp_replace(n, '^(?:{_LEAD})\\s+(.+)$', '\\1') ELSE regexp_replace(n, '^(.+?)\\s+(?:{_FORMS})$', '\\1') END AS name_core,
 CASE WHEN fr AND form IS NULL AND lead IS NOT NULL THEN lead ELSE form END AS legal_suffix FROM s"""
)
def legal_split(spark, sf_dir):
    d = values(spark, NAMES, "id int, name string, country string").withColumn("n", names.normalize_name("name"))
    core, form = names.split_legal("n", "country")
    return d.select("id", core.alias("name_core"), form.alias("legal_suffix"))


def _find_sql(pattern: str, group: int = 1, c: str = "a") -> str:
    return f"nullif(regexp_extract({c}, '(?i){pattern}', {group}), '')"


def _real(x: str) -> str:
    return f"CASE WHEN {x} NOT LIKE '00%' THEN {x} END"


#: The oracle's own copy of the fixed values.
_US_END = r"(?:^|[,;])\s*([A-Z]{2})\s+(\d{5}(?:-\d{4})?)\s*$"
_FR_CITY = r"(?:^|[,;])\s*(\d{5})\s+([\p{L}-]+)"
_FR_PART, _FR_CEDEX = r"(?:^|[,;])\s*(\d{5})\s*(?:[,;]|$)", r"(?:^|[,;])\s*(\d{5})[\p{L}][\p{L}\s-]{1,50}\s+cedex\b"
_AFTER = "('rue', 'r', 'av', 'ave', 'avenue', 'bd', 'boulevard', 'blvd', 'route', 'rte', 'chemin', 'ch', 'impasse', 'imp', 'place', 'pl', 'quai', 'q')"
_REGIONS = """('maharashtra', 'delhi', 'uttar pradesh', 'karnataka', 'tamil nadu', 'gujarat', 'west bengal', 'telangana', 'haryana', 'kerala', 'rajasthan', 'bihar',
 'madhya pradesh', 'andhra pradesh', 'orissa', 'odisha', 'punjab', 'jharkhand', 'assam', 'uttarakhand', 'hauts-de-france', 'nouvelle-aquitaine', 'pays de la loire',
 'nord', 'gironde', 'loire-atlantique', 'pas-de-calais')"""
_EMPTY = """('', 'null', '<null>', 'none', 'na', 'n/a', '""')"""
_ROADS = "road|rd|street|st|avenue|ave|boulevard|blvd|lane|ln|rue|route|rte|chemin|impasse|plot|block|floor|flr|apartment|apt|building|bldg|flat|shop|sector|highway|hwy"
_NUMBER = r"[A-Za-z]?-?\d{1,5}(?:[-/][A-Za-z0-9]{1,6}){0,5}[A-Za-z]?"
_MARKED = r"(?:^|[\s,;#])(?:h\s*\.?\s*no|house\s*no|door\s*no|plot\s*no|property\s*no|shop\s*no|flat\s*no|unit\s*no|no\.?|n[°º])\s*[:#.-]?\s*(" + _NUMBER + ")"
_FIRST = r"(?:^|[,;]\s*)#?\s*(" + _NUMBER + r")(?:\s|[,;]|$)"
_CEDEX = r"(?:^|[,;])\s*\d{5}\s*([\p{L}][\p{L}\s-]{1,50}?)\s+cedex(?:\s+\d+)?(?:[,;]|$)"
_FR = r"(?:n[°ºo]\.?\s*|#\s*)?\(?\d{1,5}\)?(?:\s*(?:bis|ter|[a-z]))?\s*(?:-\s*)?"
_SHORT = {"rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "ln": "lane", "hwy": "highway", "bldg": "building", "flr": "floor", "apt": "apartment"}
_FR_SHORT = {**_SHORT, "st": "saint", "ste": "sainte", "bd": "boulevard", "av": "avenue", "pl": "place", "imp": "impasse"}

POSTCODE_SQL = f"""CASE k WHEN 'india' THEN coalesce({_find_sql(r"\bpin(?:\s*code)?\b\s*[:#-]?\s*(\d{6})\b")}, {_find_sql(r"(?:^|[,;])\s*(\d{6})\s*(?:[,;]|$)")}, {_find_sql(r"[,;]\s*[\p{L}][\p{L}\s-]{1,50}\s+(\d{6})\s*$")})
 WHEN 'us' THEN coalesce({_find_sql(r"\b(?:zip(?:code)?|postal\s*code)\s*[:#-]?\s*(\d{5}(?:-\d{4})?)\b")}, CASE WHEN lower({_find_sql(_US_END)}) <> 'fl' THEN {_find_sql(_US_END, 2)} END)
 WHEN 'france' THEN coalesce({_real(_find_sql(_FR_PART))}, CASE WHEN lower({_find_sql(_FR_CITY, 2)}) NOT IN {_AFTER} THEN {_real(_find_sql(_FR_CITY))} END,
  {_real(_find_sql(_FR_CEDEX))}, {_find_sql(r"\b(?:code\s*postal|postal\s*code|postcode)\b\s*[:#-]?\s*(\d{5})\b")})
 ELSE coalesce({_find_sql(r"\b(?:postal\s*code|postcode)\b\s*[:#-]?\s*([A-Z]{1,2}\d[A-Z\d]?\s+\d[A-Z]{2})\b")}, {_find_sql(r"\b(?:postal\s*code|postcode|zip|pin)\b\s*[:#-]?\s*([A-Z0-9-]{4,10})\b")}, {_find_sql(r"(?:^|[,;\s])(\d{6})(?:$|[,;\s])")}) END"""
_ADDR = f"WITH {sql_values(ADDRESSES, 'v', 'id, a0, country')}, x AS (SELECT CAST(id AS INTEGER) AS id, coalesce(a0, '') AS a, lower(coalesce(country, '')) AS k FROM v)"


@query(f"{_ADDR} SELECT id, {POSTCODE_SQL} AS postcode FROM x")
def postcode_rules(spark, sf_dir):
    return values(spark, ADDRESSES, "id int, a string, country string").select("id", address.postcode("a", "country").alias("postcode"))


@query(
    f"""{_ADDR}, h AS (SELECT id, lower(coalesce({_find_sql(_MARKED)}, {_find_sql(_FIRST)})) AS h, {POSTCODE_SQL} AS p FROM x)
SELECT id, CASE WHEN h = p THEN NULL ELSE h END AS house_no FROM h"""
)
def house_no_rules(spark, sf_dir):
    d = values(spark, ADDRESSES, "id int, a string, country string")
    return d.select("id", address.house_number("a", address.postcode("a", "country")).alias("house_no"))


def _likely_sql(c: str) -> str:
    y = f"trim(regexp_replace({c}, '^\\d{{5,6}}\\s+', ''))"
    return f"""coalesce(regexp_matches({y}, '\\p{{L}}') AND NOT regexp_matches({y}, '\\d') AND NOT (regexp_matches({y}, '(?i)(?:^|\\s)(?:{_ROADS})(?:\\s|$)')
 OR (k = 'france' AND regexp_matches({y}, '(?i)(?:^|\\s)(?:r|ch|imp|bd|pl)(?:\\s|$)'))) AND length({y}) <= 60 AND {y} NOT IN {_REGIONS} AND {y} NOT IN {_EMPTY}, false)"""


@query(
    f"""{_ADDR}, p AS (SELECT *, list_filter(list_transform(string_split(a, ','), lambda s: lower(trim(s))), lambda s: s NOT IN {_EMPTY}) AS parts FROM x),
q AS (SELECT *, parts[-1] AS l1, parts[-2] AS l2, parts[-3] AS l3 FROM p),
r AS (SELECT *, coalesce(l1 IN {_REGIONS} OR (k = 'us' AND regexp_matches(l1, '(?i)^[a-z]{{2}}(?:\\s+\\d{{5}}(?:-\\d{{4}})?)?$')), false) AS region FROM q),
s AS (SELECT *, CASE WHEN region AND l2 IS NOT NULL THEN l2 ELSE l1 END AS c1, CASE WHEN region THEN l3 ELSE l2 END AS c2 FROM r),
t AS (SELECT *, CASE WHEN {_likely_sql("c1")} THEN c1 WHEN {_likely_sql("c2")} THEN c2 END AS c FROM s),
u AS (SELECT id, k, nullif({_clean_sql("regexp_replace(c, '^[0-9]{5,6}[ ]+', '')")}, '') AS plain, nullif({_clean_sql(_find_sql(_CEDEX))}, '') AS cedex FROM t)
SELECT id, CASE WHEN k = 'france' THEN regexp_replace(regexp_replace(strip_accents(coalesce(plain, cedex)), '^st\\s+', 'saint '), '^ste\\s+', 'sainte ') ELSE plain END AS city FROM u"""
)
def city_rules(spark, sf_dir):
    return values(spark, ADDRESSES, "id int, a string, country string").select("id", address.city("a", "country").alias("city"))


@query(
    f"""{_ADDR}, f AS (SELECT *, regexp_replace(regexp_replace(a, '(?i)(^|[,;]\\s*)((?:{_FR})?)r\\.?\\s+', '\\1\\2rue ', 'g'), '(?i)(^|[,;]\\s*)({_FR})ch\\.?\\s+', '\\1\\2chemin ', 'g') AS fa FROM x)
SELECT id, CASE WHEN k = 'france' THEN strip_accents({_expand_sql(_clean_sql("fa"), _FR_SHORT)}) ELSE {_expand_sql(_clean_sql("a"), _SHORT)} END AS addr_norm FROM f"""
)
def normalize_addresses(spark, sf_dir):
    return values(spark, ADDRESSES, "id int, a string, country string").select("id", address.normalize_address("a", "country").alias("addr_norm"))


@query()
def normalize_records(spark, sf_dir):
    return normalize(records(spark, sf_dir))


@query(
    f"""WITH {RECORDS}, n AS (SELECT country, {NAME_SQL} AS name_norm, {_expand_sql(_clean_sql("address"), _SHORT)} AS addr_norm, regexp_matches(name, '[^\\P{{L}}\\p{{Latin}}]') AS other FROM records)
SELECT country, count(*) AS n, count(*) FILTER (name_norm <> '') AS n_name_norm, count(*) FILTER (addr_norm <> '') AS n_addr_norm, count(*) FILTER (other) AS n_other_script FROM n GROUP BY country"""
)
def fill_report(spark, sf_dir):
    return reports.fill_report(normalize(records(spark, sf_dir)).select("country", "name_norm", "addr_norm", "script"))


TOKENS_SQL = """list_filter(string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '')"""


@query(
    f"""WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format(c="text")} AS w FROM conversations WHERE text IS NOT NULL),
p AS (SELECT a.w AS a, b.w AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w) = len(b.w) AND len(a.w) > 0),
v AS (SELECT a[i] AS tok, b[i] AS new FROM p, unnest(range(1, len(a) + 1)) AS r(i)),
c AS (SELECT tok, new, count(*) AS v FROM v GROUP BY 1, 2),
k AS (SELECT *, sum(v) OVER (PARTITION BY tok) AS n, row_number() OVER (PARTITION BY tok ORDER BY v DESC, new) AS r FROM c)
SELECT tok, new, v AS votes, round(v / n, 6) AS share FROM k WHERE r = 1 AND v >= 0.6 * n"""
)
def token_vote_map(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", text.clean_text("text").alias("w"))
    pairs = t.join(t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("w2")), ["conv_id", "turn"])
    return learn_token_map(pairs, "w", "w2")


VOTES = [(1, "shri ram traders", "श्री राम ट्रेडर्स"), (2, "ram motors", "राम मोटर्स"), (3, "raam motors", "राम मोटर्स"), (4, "ram", "राम"), (5, "two words", "एक")]


@query(
    f"""WITH {sql_values(VOTES, "v", "id, latin_name, dev_name")}, p AS (SELECT string_split(dev_name, ' ') AS a, string_split(latin_name, ' ') AS b FROM v),
x AS (SELECT a[i] AS tok, b[i] AS new FROM p, unnest(range(1, len(a) + 1)) AS r(i) WHERE len(a) = len(b)), c AS (SELECT tok, new, count(*) AS n FROM x GROUP BY 1, 2),
m AS (SELECT tok, new FROM c QUALIFY row_number() OVER (PARTITION BY tok ORDER BY n DESC, new) = 1 AND n >= 0.6 * sum(n) OVER (PARTITION BY tok)),
k AS (SELECT CAST(id AS INTEGER) AS id, string_split(dev_name, ' ') AS a FROM v), t AS (SELECT id, i, coalesce(new, a[i]) AS w FROM k, unnest(range(1, len(a) + 1)) AS r(i) LEFT JOIN m ON m.tok = a[i]),
j AS (SELECT id, string_agg(w, ' ' ORDER BY i) AS c FROM t GROUP BY 1) SELECT id, {_latin_sql('c')} AS latin FROM j"""
)
def learned_map_names(spark, sf_dir):
    d = values(spark, VOTES, "id int, latin_name string, dev_name string")
    token_map = learn_token_map(d, "dev_name", "latin_name", min_share=0.6)
    return scripts.with_known_tokens(d, "dev_name", token_map).select("id", scripts.transliterate("dev_name").alias("latin"))
