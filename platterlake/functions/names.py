"""Names, tags, modes and codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File type bits of a Unix mode and their letters.
MODE_TYPES = ((0o040000, "d"), (0o120000, "l"), (0o060000, "b"), (0o020000, "c"), (0o010000, "p"), (0o140000, "s"))
#: DOS attribute bits and their letters.
DOS_ATTRIBUTES = ((0x01, "R"), (0x02, "H"), (0x04, "S"), (0x20, "A"))


def mode_string(mode: Column) -> Column:
    """ls-style text of a Unix mode with its special bits."""
    bit = lambda b: mode.bitwiseAND(F.lit(b)) != 0
    kind = F.lit("-")
    for value, letter in MODE_TYPES:
        kind = F.when(mode.bitwiseAND(F.lit(0o170000)) == value, letter).otherwise(kind)
    parts = [kind]
    for shift, special, letter in ((6, 0o4000, "s"), (3, 0o2000, "s"), (0, 0o1000, "t")):
        run, marked = bit(1 << shift), bit(special)
        parts += [F.when(bit(4 << shift), "r").otherwise("-"), F.when(bit(2 << shift), "w").otherwise("-")]
        parts.append(F.when(run & marked, letter).when(run, "x").when(marked, letter.upper()).otherwise("-"))
    return F.concat(*parts)


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.bitwiseAND(F.lit(0o7777)).cast("string"), 10, 8), 4, "0")


def attribute_letters(attributes: Column) -> Column:
    return F.concat(*(F.when(attributes.bitwiseAND(F.lit(b)) != 0, letter).otherwise("") for b, letter in DOS_ATTRIBUTES))


def extension(name: Column) -> Column:
    """Upper-case text after the last dot, or nothing."""
    return F.upper(F.regexp_extract(name, r"\.([^.]*)$", 1))


def type_tag(kind: Column, name: Column, special: Column, code: Column, attributes: Column, mode: Column) -> Column:
    """What a listing shows as a row's type; the first kind of type that the row has."""
    of_file = F.coalesce(F.nullif(code, F.lit("")), F.when(attributes.isNotNull(), attribute_letters(attributes)), F.when(mode.isNotNull(), octal_mode(mode)), extension(name))
    return F.when(kind == "directory", "<DIR>").when(kind == "symlink", "->").when(kind == "special", F.coalesce(special, F.lit("(special)"))).otherwise(of_file)


def sanitize(name: Column) -> Column:
    """Letters, digits, underscores and single inner hyphens; anything else becomes a hyphen."""
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]+", "-"), "^-|-$", "")


def control_pictures(name: Column) -> Column:
    """C0 controls and DEL as their visible pictures."""
    return F.translate(name, "".join(map(chr, [*range(1, 32), 127])), "".join(map(chr, [*range(0x2401, 0x2420), 0x2421])))


def text_kind(text: Column) -> Column:
    """By its first character that is no white space, of the first 128: jsonl for a brace where another line follows, json
    for a brace or a bracket, else txt. A line end that begins the text, or ends it, starts no other line."""
    first = F.regexp_extract(F.substring(text, 1, 128), r"\A[ \t\n\r\f]*([^ \t\n\r\f])", 1)
    lines = text.rlike(r"(?s).\n[^\n]")
    return F.when((first == "{") & lines, "jsonl").when(first.isin("{", "["), "json").otherwise("txt")


def ostype(code: Column) -> Column:
    """Four bytes for display: printable ASCII, and a dot for any other byte."""
    return F.regexp_replace(F.decode(code, "ISO-8859-1"), "[^ -~]", ".")


def prodos_code(kind: Column) -> Column:
    return F.format_string("$%02X", kind)


def guid_text(raw: Column) -> Column:
    """A GUID of 16 bytes, whose first three fields are stored little-endian."""
    h = F.hex(raw)
    part = lambda at: F.substring(h, 2 * at + 1, 2)
    take = lambda places: F.concat(*map(part, places))
    return F.concat_ws("-", take((3, 2, 1, 0)), take((5, 4)), take((7, 6)), take((8, 9)), take((10, 11, 12, 13, 14, 15)))


def is_appledouble(name: Column) -> Column:
    return F.startswith(name, F.lit("._"))


def safe_path(path: Column) -> Column:
    """Neither absolute nor leaving its folder."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def valid_name(name: Column, longest: int = 255, forbidden: str = r"[/\x00]") -> Column:
    return (F.length(name) > 0) & (F.length(name) <= longest) & ~name.rlike(forbidden)


def key_value(line: Column, key: str) -> Column:
    """The value of key=value in a line of attributes."""
    return F.regexp_extract(line, rf"(?:^|[\s,]){key}\s*=\s*([^,\s]+)", 1)


def device_numbers(device: Column) -> Column:
    """struct(major, minor) of a packed Linux device number."""
    major = F.shiftright(device, 8).bitwiseAND(F.lit(0xFFF))
    minor = device.bitwiseAND(F.lit(0xFF)).bitwiseOR(F.shiftright(device, 12).bitwiseAND(F.lit(0xFFF00)))
    return F.struct(major.alias("major"), minor.alias("minor"))


def name_hash(name: Column, size: int = 72) -> Column:
    """Bucket of an upper-cased name in a hashed directory of that many chains."""
    letters = F.transform(F.split(F.upper(name), ""), lambda c: F.ascii(c))
    step = lambda a, c: ((a * 13 + c).bitwiseAND(F.lit(0x7FF))).cast("int")
    return F.aggregate(F.filter(letters, lambda c: c > 0), F.length(name).cast("int"), step) % size
