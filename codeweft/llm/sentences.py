"""Sentence units across languages and scripts, in SQL expressions (problem 9).

A text is first parted into blocks: fenced code, headings, list items and paragraphs (blank lines part them). The first
three are one unit each. In a paragraph every terminator that ends nothing (decimals and addresses have no blank after
them; abbreviations, initials, ordinals of dates, terminators within a quotation) is replaced by a private-use
placeholder of the same length, boundaries are found by terminator patterns of the scripts, and the placeholders are
turned back. Lengths never change, so positions are sums of lengths. All of it happens within the row of a text: nothing
is shuffled.

An abbreviation that can close a sentence (etc., p.m., и т. д.) closes it where the next word doesn't begin in lower
case; identifiers such as `readUser` or `a/b.c` count as beginnings. An open
fence runs to the end of the text. Null, empty and blank texts have no units. Private-use characters of the
placeholder block that a text holds itself are read as any other symbol; its sentences are then cut from the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "\U000F0000"  # a boundary
# terminator -> placeholder
_TERMINATORS = ".!?。！？।؟"
_MASKS = "".join(chr(0xF0010 + i) for i in range(len(_TERMINATORS)))
_OPEN, _CLOSE, _DE = "\U000F0030", "\U000F0031", "\U000F0032"  # straight quote that opens, one that closes, German closing quote
_NUMBERED_LINE = "\U000F0033"  # stands at the end of a line that begins with a number, while blocks are parted

# Abbreviations, fixed values. Those that never end a sentence:
_NEVER = (
    "Dr Mr Mrs Ms Prof St Messrs Gen Col Lt Sgt Capt Rev Hon vs cf Cf approx Approx e.g i.e E.g I.e viz resp al.g Fig fig Figs figs Eq eq Ref ref Ch ch Vol vol ed eds esp "
    "ca vgl Vgl bzw Nr Abs Fa Hr Fr evtl ggf inkl sog Str Tel z.B d.h u.a Mme Mlle MM art Art Sr Sra Srta Dra D.ª pág págs núm Núm Ud Uds "
    "См см стр Стр ср Ср рис табл гл им г-н г-жа डॉ श्री मि.से कि.मी"
).split()
# Those that never end one where a number follows:
_NUMBERED = "No no Nos nos Sec sec Secs p pp P S Bd Kap Rn Art art n Nº nº п с ч Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec".split()
# Abbreviations of several parts, written with blanks, that never end a sentence:
_SPACED = ["z. B", "d. h", "u. a", "i. d. R", "p. ex", "p. ej", "p. e", "т. е", "т. к", "EE. UU"]
_MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

# Blank characters, fixed values (white space of the Unicode standard and the separators of ASCII).
_SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BLANK = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"  # the same as ranges, which match faster
_OWN = r"[\x{F0000}-\x{F0033}]"  # any placeholder
_NUMBER = r"[ \t]{0,8}\d{1,3}[.)][ \t]"
_ITEM = rf"(?:[ \t]{{0,8}}[-*•‣▪+][ \t]+|{_NUMBER})"
_BLOCKS = (
    r"(?ms)^(?:([ \t]{0,3}(`{3,}|~{3,})[^\n]*(?:\n.*?)??(?:^[ \t]{0,3}\2[`~]*[ \t]*\r?$|\z))"
    r"|([ \t]{0,3}#{1,6}(?:[ \t][^\n]*)?$)"
    r"|([ \t]{0,8}[-*•‣▪+][ \t]+[^\n]*$"
    # a numbered item comes first, after a blank line or after another one
    rf"|(?={_NUMBER})(?:(?<=\A)|(?<=\n[ \t]{{0,8}}\r?\n)|(?<={_NUMBERED_LINE}\n)){_NUMBER}[^\n]*$)"
    r"|([ \t]*\r?\n))"
)
_OPENERS = "“„«「『（(\\[‘¿¡‹" + _OPEN
_CLOSERS = "”»」』）)\\]’›" + _CLOSE + _DE
_IN, _OUT = "“„«「『" + _OPEN, "”»」』" + _CLOSE + _DE
_IDENT = r"[\p{L}\p{N}]*(?:\p{Lu}|_|[./](?=\p{L})|\(\))"
_STARTS = rf"(?=[^\s,;:)\]}}–—»›”’」』-])(?![{_OPENERS}]*\p{{Ll}}(?!{_IDENT}))"


def _esc(words: list[str]) -> str:
    return "|".join(sorted((w.replace(".", r"[.\x{F0010}]").replace(" ", r"\s{1,3}") for w in words), key=len, reverse=True))


def _behind(words: list[str], before: str) -> str:
    """What one of the words and a dot stand right before, the character before them not in `before`: words of one length at once."""
    plain = sorted({w for w in words if "." not in w and " " not in w}, key=lambda w: (len(w), w))
    out = [rf"(?<=(?<!{before})(?:{'|'.join(g)})\.)" for g in ([w for w in plain if len(w) == n] for n in sorted({len(w) for w in plain}))]
    rest = [w for w in words if w not in plain]
    return "|".join(out + ([rf"(?<=(?<!{before})(?:{_esc(rest)})\.)"] if rest else []))


# A dot before a blank that ends nothing: parts of spaced abbreviations, abbreviations, numbered ones, initials, days of dates.
_WORD_BEFORE = r"[\p{L}\p{M}\p{N}_]"
_ENDS_NOTHING = (
    r"\.(?=\s)(?:(?=\s{1,3}(?:B|h|a|d|R|ex|ej|e|е|к|д|п|UU)\.)(?<=(?<![\p{L}\p{N}])(?:z|d|u|i|p|т|EE)\.)"
    rf"|{_behind(_SPACED + _NEVER, _WORD_BEFORE)}|(?<=\([sv]\.)"
    rf"|(?=\s{{1,3}}[#§]?\p{{N}})(?:{_behind(_NUMBERED, _WORD_BEFORE)})"
    r"|(?=\s{1,3}\p{Lu}[\p{Ll}'’.])(?<=(?<![\p{L}\p{N}.'’-])(?:\p{Lu}|Th|Ch)\.)"
    rf"|(?=\s{{1,3}}(?:{_MONTHS})\b)(?<=(?<![\p{{L}}\p{{N}}.,])\d{{1,2}}\.))"
)


def _placeholder(c: str) -> str:
    return _MASKS[_TERMINATORS.index(c)]


# What asks for more than the rules of Latin, Cyrillic and the like without quotations: quotation marks, other scripts.
# Tests of a block come before patterns, since a class of many characters is slow to search.
_BEYOND = r"[^\x00-\x7F]"
_QUOTED = "[“„«「『\"]"
_EAST = r"[\x{0E00}-\x{0E7F}。！？｡]"
_MARKED = rf"[{_OUT}’‘।؟॥۔]"
_GROUP = 32  # lengths that are summed at once


def _masked(p: Column, quoted: bool) -> Column:
    """A paragraph with placeholders for terminators that end no sentence."""
    dot = _placeholder(".")
    if quoted:
        p = _quotes(p)
    return _inside(F.regexp_replace(p, _ENDS_NOTHING, dot)) if quoted else F.regexp_replace(p, _ENDS_NOTHING, dot)


def _quotes(p: Column) -> Column:
    """German closing quotes and straight ones told apart from opening ones."""
    p = F.regexp_replace(p, rf"„([^„“”]*+)“", f"„$1{_DE}")
    p = F.regexp_replace(p, r"\"(?<![\p{L}\p{N}_{\[,:\\]\")(?=\S)([^\"]++)(?<=\S)\"", f"{_OPEN}$1{_CLOSE}")
    return p


def _inside(p: Column) -> Column:
    """Placeholders for terminators within quotations, those before the closing quote excepted."""
    quoted = rf"^[{_IN}][^{_IN}{_OUT}]*[{_OUT}]$"

    def mask(q: Column) -> Column:
        tail = F.regexp_extract(q, rf"([\s{_TERMINATORS}…]*[{_OUT}])$", 1)
        return _let(tail, lambda x: F.concat(F.translate(q.substr(F.lit(1), F.length(q) - F.length(x)), _TERMINATORS, _MASKS), x))

    parts = F.split(p, rf"(?=[{_IN}])|(?<=[{_OUT}])")
    return F.array_join(F.transform(parts, lambda q: F.when(q.rlike(quoted), mask(q)).otherwise(q)), "")


def _parted(p: Column, quoted: bool = False, marks: bool = False, east: bool = False) -> Column:
    """A paragraph with CUT at the ends of its sentences, placeholders turned back."""
    p = _masked(p, quoted)
    ends = "[.!?…।॥؟۔]+" if quoted or marks or east else "[.!?…]+"
    p = F.regexp_replace(p, rf"({ends}[)\]）]*)(?={_BLANK}+{_STARTS})", f"$1{CUT}")
    if quoted or marks or east:
        # after a closing quote, a letter without case tells nothing: most often the sentence that holds the quote goes on
        p = F.regexp_replace(p, rf"([.!?…।॥؟۔]+(?:[\x{{A0}}\x{{202F}} ]?[»›]|[{_CLOSERS}\"'])+)(?={_BLANK}+{_STARTS})(?!{_BLANK}+\p{{Lo}})(?<=[^)\]）])", f"$1{CUT}")
    if east:
        p = F.regexp_replace(p, rf"([。！？｡]+[{_CLOSERS}]*)(?={_BLANK})", f"$1{CUT}")
        p = F.regexp_replace(p, rf"([。！？｡]+)(?![。！？｡{_CLOSERS}\s{CUT}])", f"$1{CUT}")
        p = F.regexp_replace(p, r"(?<=[\x{0E00}-\x{0E7F}])(?=\s+[\x{0E00}-\x{0E7F}])", CUT)
    return _let(p, lambda x: F.when(x.rlike(r"[\x{F0010}-\x{F0032}]"), F.translate(x, _MASKS + _OPEN + _CLOSE + _DE, _TERMINATORS + '""“')).otherwise(x))


def _let(c: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, n: a + n)


def _heads(lengths: Column) -> Column:
    """Of an array of lengths, what comes before each group of _GROUP."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _GROUP).cast("int")), lambda g: _sum(F.slice(lengths, g * _GROUP + 1, F.lit(_GROUP))))
    return F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def units(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sent_no bigint from 0, end_pos bigint, sentence) of every unit that is not blank."""
    own = "".join(chr(c) for c in (0xF0000, 0xF0030, 0xF0031, 0xF0032, 0xF0033)) + _MASKS
    src = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null and t <> ''")
    rows = src.select("k", F.when(F.col("t").rlike(_OWN), F.col("t")).alias("own"), "t").select("k", "own", F.when(F.col("own").isNull(), F.col("t")).otherwise(F.translate("t", own, "�" * len(own))).alias("t"))
    marked = F.regexp_replace("t", rf"(?md)^({_NUMBER}[^\n]*+)(?=\n)", f"$1{_NUMBERED_LINE}")
    parted = F.translate(F.regexp_replace(marked, _BLOCKS, f"{CUT}$1$3$4{CUT}$5"), _NUMBERED_LINE, "")

    def parts(b: Column) -> Column:
        whole = b.rlike(rf"^(?:[ \t]{{0,3}}(?:`{{3}}|~{{3}}|#{{1,6}}(?:\s|$)))|^{_ITEM}[^\n]*\r?$")
        cut = F.when(~b.rlike(_BEYOND) & ~F.contains(b, F.lit('"')), _parted(b))
        cut = cut.when(b.rlike(_QUOTED), F.when(b.rlike(_EAST), _parted(b, True, True, True)).otherwise(_parted(b, True, True)))
        cut = cut.when(b.rlike(_EAST), _parted(b, False, True, True)).when(b.rlike(_MARKED), _parted(b, False, True)).otherwise(_parted(b))
        return F.when(whole, F.array(b)).otherwise(F.split(cut, CUT))

    pieces = rows.select("k", "own", F.flatten(F.transform(F.split(parted, CUT), parts)).alias("p"))
    sized = pieces.select("k", "own", "p", F.transform("p", lambda x: F.length(x).cast("bigint")).alias("n"))
    headed = sized.select("k", "own", "p", "n", _heads(F.col("n")).alias("h"))

    def unit(x: Column, i: Column) -> Column:
        g = F.floor(i / _GROUP).cast("int")
        kept = F.rtrim(x, F.lit(_SPACES))
        before = F.get("h", g) + _sum(F.slice("n", g * _GROUP + 1, i - g * _GROUP))
        return F.struct((before + F.length(kept)).alias("end_pos"), F.ltrim(kept, F.lit(_SPACES)).alias("sentence"))

    shown = headed.select("k", "own", F.posexplode(F.filter(F.transform("p", unit), lambda u: u["sentence"] != "")).alias("no", "u"))
    sentence = F.when(F.col("own").isNull(), F.col("u.sentence")).otherwise(F.expr("substring(own, cast(u.end_pos as int) - length(u.sentence) + 1, length(u.sentence))"))
    return shown.select(F.col("k").alias(key), F.col("no").cast("bigint").alias("sent_no"), F.col("u.end_pos").alias("end_pos"), sentence.alias("sentence"))
