r"""Lines, sentences, tokens and the string functions around them, as Column expressions.

Null in, null out, unless stated otherwise. Character classes are Unicode categories: letters, numbers and
marks make words, separators (Z) divide them, anything else (control characters included) is a token of
its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = r"[\p{L}\p{N}\p{M}]"
_CORE = r"(?<=[\p{L}\p{N}])"
_APOSTROPHE = rf"{_CORE}'{_WORD}*"
_INNER_APOSTROPHE = rf"{_CORE}'{_WORD}+"
_HYPHEN = rf"{_CORE}-(?=[\p{{L}}\p{{N}}]){_WORD}+"


def lines(text: Column) -> Column:
    """Trimmed lines; blank ones are kept, so that their number is their place."""
    return F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.trim(x))


def sentences(line: Column) -> Column:
    """A sentence ends with . ! or ? before blanks. No quotes are tracked; see kernels.quoted_sentences."""
    return F.filter(F.split(F.regexp_replace(F.trim(line), r"([.!?])[ \t]+", "$1\n"), "\n"), lambda x: F.trim(x) != "")


def tokens(sentence: Column, contractions: bool = True, hyphenated: bool = True, trailing_apostrophe: bool = True) -> Column:
    """Words and single other characters; inner apostrophes and hyphens stay inside a word if asked for."""
    joints = ([_APOSTROPHE if trailing_apostrophe else _INNER_APOSTROPHE] if contractions else []) + ([_HYPHEN] if hyphenated else [])
    tail = f"(?:{'|'.join(joints)})*" if joints else ""
    return F.regexp_extract_all(sentence, F.lit(rf"({_WORD}+{tail}|[^\p{{Z}}\p{{L}}\p{{N}}\p{{M}}])"), F.lit(1))


def whitespace_tokens(line: Column) -> Column:
    """Split at white space; a final run of . ! ? of a longer token is a token of its own."""
    parts = F.filter(F.split(line, r"\s+"), lambda x: x != "")
    apart = F.transform(parts, lambda x: F.when(x.rlike(r"^.*[^.!?][.!?]+$"), F.array(F.regexp_extract(x, r"^(.*[^.!?])([.!?]+)$", 1), F.regexp_extract(x, r"^(.*[^.!?])([.!?]+)$", 2))).otherwise(F.array(x)))
    return F.flatten(apart)


def collapsed_sentences(text: Column) -> Column:
    """White space collapsed to one blank; split behind runs of . ! ? that a blank or the end follows."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(F.regexp_replace(flat, r"([.!?]+) ", "$1\n"), "\n"), lambda x: x != "")


def punctuation_apart(word: Column) -> Column:
    """Runs of word characters and each other character of a word."""
    return F.regexp_extract_all(word, F.lit(r"([\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s])"), F.lit(1))


def ascii_tokens(sentence: Column) -> Column:
    """Tokens by ASCII classes: alphanumerics and all non-ASCII characters make words, ' and - join inside them."""
    return F.regexp_extract_all(sentence, F.lit(r"([A-Za-z0-9\x{80}-\x{10FFFF}]+(?:['-][A-Za-z0-9\x{80}-\x{10FFFF}]+)*|[\x21-\x7E])"), F.lit(1))


def case_class(form: Column) -> Column:
    """UU all upper case (two letters or more), Ul initial upper case, ll initial lower case, ?? other."""
    return F.when(form.isNull(), None).when(form.rlike(r"^\p{Lu}") & (F.upper(form) == form) & (F.length(form) > 1), "UU").when(form.rlike(r"^\p{Lu}"), "Ul").when(form.rlike(r"^\p{Ll}"), "ll").otherwise("??")


def align_key(form: Column) -> Column:
    """Lower-case letters and numbers; the lower-case form itself if there are none."""
    bare = F.regexp_replace(F.lower(form), r"[^\p{L}\p{N}]", "")
    return F.when(bare != "", bare).otherwise(F.lower(form))


def feats_normal(feats: Column) -> Column:
    """K=V pairs sorted, malformed ones dropped; _ if none is left, null counts as _."""
    pairs = F.filter(F.transform(F.split(F.coalesce(feats, F.lit("_")), r"\|"), lambda x: F.trim(x)), lambda x: x.contains("="))
    joined = F.array_join(F.array_sort(pairs), "|")
    return F.when(joined == "", "_").otherwise(joined)


def feats_map(feats: Column) -> Column:
    """map<string, string> of a FEATS string; of repeated names the last counts."""
    pairs = F.filter(F.split(F.coalesce(feats, F.lit("_")), r"\|"), lambda x: x.contains("="))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != F.substring_index(x, "=", 1)), F.create_map(F.substring_index(x, "=", 1), F.regexp_replace(x, "^[^=]*=", ""))))
    return last


def feats_within(part: Column, whole: Column) -> Column:
    """Every feature of `part` is in `whole` with the same value (FEATS strings; _ is within anything)."""
    pairs = lambda c: F.filter(F.split(F.coalesce(c, F.lit("_")), r"\|"), lambda x: x.contains("="))
    return F.size(F.array_except(pairs(part), pairs(whole))) == 0


#: UniMorph names and the UD tags and features they stand for; fixed values.
UNIMORPH_POS = {"N": "NOUN", "V": "VERB", "ADJ": "ADJ", "ADV": "ADV", "PRON": "PRON", "DET": "DET", "PREP": "ADP", "ADP": "ADP", "CONJ": "CCONJ", "SCONJ": "SCONJ", "NUM": "NUM", "PUNCT": "PUNCT"}
UNIMORPH_FEATS = {
    "PST": "Tense=Past", "PRS": "Tense=Pres", "FUT": "Tense=Fut", "1": "Person=1", "2": "Person=2", "3": "Person=3",
    "SG": "Number=Sing", "PL": "Number=Plur", "MASC": "Gender=Masc", "FEM": "Gender=Fem", "NEUT": "Gender=Neut",
    "NOM": "Case=Nom", "ACC": "Case=Acc", "GEN": "Case=Gen", "DAT": "Case=Dat", "IND": "Mood=Ind", "SUB": "Mood=Sub", "IMP": "Mood=Imp",
    "IPFV": "Aspect=Imp", "PFV": "Aspect=Perf", "ACT": "Voice=Act", "PASS": "Voice=Pass",
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def unimorph_to_ud(features: Column) -> Column:
    """struct<upos, feats> of a UniMorph bundle such as V;IND;SG; the last part of speech named counts."""
    parts = F.transform(F.split(F.coalesce(features, F.lit("")), ";"), lambda x: F.trim(x))
    pos = F.filter(F.transform(parts, lambda x: F.try_element_at(_lookup(UNIMORPH_POS), x)), lambda x: x.isNotNull())
    feats = F.filter(F.transform(parts, lambda x: F.try_element_at(_lookup(UNIMORPH_FEATS), x)), lambda x: x.isNotNull())
    return F.struct(F.when(F.size(pos) > 0, F.element_at(pos, -1)).otherwise("_").alias("upos"), F.when(F.size(feats) > 0, F.array_join(F.array_sort(feats), "|")).otherwise("_").alias("feats"))


def tag_of(kind: str, upos: Column, xpos: Column, feats: Column) -> Column:
    """The tag a model is trained on: `upos`, `xpos`, or `utot`, UPOS and FEATS joined by #."""
    if kind == "utot":
        return F.when(F.coalesce(feats, F.lit("_")).isin("", "_"), upos).otherwise(F.concat_ws("#", upos, feats))
    return {"upos": upos, "xpos": xpos}[kind]


def form_escaped(form: Column) -> Column:
    r"""The FORM column: empty becomes _, a literal underscore \_."""
    return F.when(F.coalesce(form, F.lit("")) == "", "_").when(form == "_", "\\_").otherwise(F.regexp_replace(form, r"[\t\n]", " "))


def form_unescaped(column: Column) -> Column:
    return F.when(column == "_", "").when(column == "\\_", "_").otherwise(column)


def misc_name(raw: Column) -> Column:
    """A field name without leading #, what follows a bracket, and a numbered suffix; other signs become one underscore. Null where nothing is left, or letters beyond ASCII.

    Gloss[en], Gloss(2), Ref_1 and a.b are Gloss, Gloss, Ref and a_b.
    """
    bare = F.regexp_replace(F.regexp_replace(raw, r"^[\s#]+", ""), r"(?s)\s*(?:[\[(].*)?$", "")
    unnumbered = F.regexp_replace(bare, r"[-_.][0-9]+$", "")
    name = F.regexp_replace(F.regexp_replace(unnumbered, "[^A-Za-z0-9]+", "_"), "^_|_$", "")
    return F.when(unnumbered.rlike(r"^\p{ASCII}*$"), F.nullif(name, F.lit("")))


def length_bucket(n: Column) -> Column:
    return F.when(n <= 2, "1-2").when(n <= 4, "3-4").when(n <= 7, "5-7").when(n <= 10, "8-10").otherwise("11+")


def frequency_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").when(n < 100, "20-99").otherwise("100+")


def only_case_differs(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)) & (a != b)


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds)


def rejoined(text: Column) -> Column:
    """Word halves around a hyphen at a line's end become one word."""
    return F.regexp_replace(text, r"(\p{L})[-\x{00AD}\x{2010}][ \t]*\n[ \t]*(?=\p{Ll})", "$1")


def detected_format(text: Column) -> Column:
    """`teitok`, `conllu` or `raw`, from the first 4,096 characters."""
    head = F.substring(text, 1, 4096)
    tabs = F.length(head) - F.length(F.replace(head, F.lit("\t"), F.lit("")))
    return F.when(head.rlike(r"<tok[\s>]|<TEI[\s>]"), "teitok").when(head.rlike(r"(?m)^# ?(?:sent_id|text|newdoc|newpar|global\.columns)\b") | (tabs >= 10), "conllu").otherwise("raw")


def plain_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles, notes and comments dropped, blocks on lines of their own, at most one blank line."""
    steps = [(r"(?is)<(script|style|note|nav)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)</?(p|div|h[1-6]|li|br|tr|article|body|head|title)\b[^>]*>", "\n"), (r"<[^>]*>", ""), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", "\""), (r"&amp;", "&"), (r"[ \t]+", " "), (r" ?\n ?", "\n"), (r"\n{3,}", "\n\n")]
    return F.trim(reduce(lambda x, s: F.regexp_replace(x, *s), steps, html), F.lit(" \n"))


def language_of_path(path: Column) -> Column:
    """Language code of a treebank file such as en_ewt-ud-test.conllu."""
    return F.nullif(F.regexp_extract(path, r"(?:^|/)([a-z]{2,3})_[A-Za-z0-9]+-ud-(?:train|dev|test)[^/]*\.conllu$", 1), F.lit(""))


def softmax(scores: Column, k: int = 10) -> Column:
    """Shares of the k largest log scores, largest first."""
    top = F.slice(F.sort_array(scores, asc=False), 1, k)
    powers = F.transform(top, lambda x: F.exp(x - F.element_at(top, 1)))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def model_rating(name: Column) -> Column:
    """struct<speed, accuracy> ratings that a model's name gives away."""
    low = F.lower(name)
    large, small = low.rlike(r"(_trf|_lg|large|_full)$"), low.rlike(r"(_sm|small|_fast|tiny)$")
    return F.struct(F.when(large, 1).when(small, 3).otherwise(2).alias("speed"), F.when(large, 3).when(small, 1).otherwise(2).alias("accuracy"))


def sanitized(data: Column) -> Column:
    """Text of bytes or of a string, with what isn't UTF-8 replaced and control characters but tab and newline dropped."""
    return F.regexp_replace(F.make_valid_utf8(data), r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}\x{FEFF}]", "")


def decoded(data: Column) -> Column:
    """struct<encoding, text> of the bytes of a file: by byte order mark, else UTF-8 where they are valid, else Latin-1."""
    head = F.hex(F.substring(data, 1, 3))
    encoding = F.when(head == "EFBBBF", "UTF-8-SIG").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(F.is_valid_utf8(data.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    rest = lambda n: F.substring(data, F.lit(n + 1), F.length(data))
    text = F.when(encoding == "UTF-8-SIG", F.decode(rest(3), "UTF-8")).when(encoding == "UTF-16LE", F.decode(rest(2), "UTF-16LE")).when(encoding == "UTF-16BE", F.decode(rest(2), "UTF-16BE")).when(encoding == "UTF-8", F.decode(data, "UTF-8")).otherwise(F.decode(data, "ISO-8859-1"))
    return F.struct(encoding.alias("encoding"), text.alias("text"))


def own_id(tokid: Column) -> Column:
    """A token id without those made up by numbering (s3-t7), which are not shown."""
    return F.when(~tokid.rlike(r"^s\d+-t\d+$"), tokid)


def plain_name(name: Column) -> Column:
    """A language name for comparison: lower case, letters and numbers alone, no marks."""
    return F.regexp_replace(F.lower(F.translate(name, "áàâäãåéèêëíìîïóòôöõúùûüçñÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "aaaaaaeeeeiiiiooooouuuucnAAAAAAEEEEIIIIOOOOOUUUUCN")), r"[^\p{L}\p{N}]", "")


def position_bucket(tok_no: Column, n: Column) -> Column:
    """Where a token stands in its sentence: first, last, and thirds between."""
    return F.when(tok_no == 0, "first").when(tok_no == n - 1, "last").when(tok_no * 3 < n, "early").when(tok_no * 3 < n * 2, "middle").otherwise("late")
