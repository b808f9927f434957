"""Input formats: base,key=value ... with keys d (delimiter), q (quotes), b (backslash), u (open quotes), h (header), x (marked header)."""

from __future__ import annotations

from dataclasses import dataclass, replace

NAMED = {"tab": "\t", "space": " ", "comma": ",", "pipe": "|", "semi": ";", "semicolon": ";", "colon": ":"}
#: Pairs of quotes of the multi mode.
LOG_QUOTES = (('"', '"'), ("[", "]"))


@dataclass(frozen=True)
class Format:
    """delimiter: a text, or whole, white-drop, white-keep. quotes: pairs of open and close."""

    delimiter: str = "\t"
    mode: str = "text"
    quotes: tuple[tuple[str, str], ...] = ()
    backslash: bool = False
    unterminated: str = "continue"
    header: bool = False
    marked: str = "optional"
    crlf: bool = False

    @property
    def simple(self) -> bool:
        return not self.quotes and not self.backslash


BASES = {
    "text": Format(),
    "csv": Format(delimiter=",", quotes=(('"', '"'),), crlf=True),
    "tsv": Format(backslash=True),
    "whole": Format(mode="whole"),
    "clf": Format(delimiter=" ", quotes=LOG_QUOTES, backslash=True),
}
BASES["log"] = BASES["clf"]


def _char(value: str) -> str:
    if value in NAMED:
        return NAMED[value]
    if value.startswith("ch:"):
        return value[3:4]
    if value.startswith("str:"):
        return value[4:]
    return value


def _yes(value: str) -> bool:
    if value.lower() in ("yes", "y", "on", "true", "1", ""):
        return True
    if value.lower() in ("no", "n", "off", "false", "0"):
        return False
    raise ValueError(f"not yes or no: {value!r}")


def parse(spec: str = "") -> Format:
    """A format from text such as csv, csv,h=yes, d=comma,q=\", d=white-drop."""
    out = Format()
    for k, part in enumerate(p for p in spec.split(",") if p):
        key, eq, value = part.partition("=")
        if not eq:
            if k or key not in BASES:
                raise ValueError(f"format {spec!r}: no base {key!r}")
            out = BASES[key]
        elif key == "d":
            mode = {"whole": "whole", "white": "white-drop", "white-drop": "white-drop", "white-keep": "white-keep"}.get(value)
            out = replace(out, mode=mode or "text", delimiter=out.delimiter if mode else _char(value))
        elif key == "q":
            pairs = () if value in ("none", "no") else LOG_QUOTES if value in ("multi", "clf") else ((value[0], value[-1]),)
            out = replace(out, quotes=pairs)
        elif key == "b":
            out = replace(out, backslash=_yes(value))
        elif key == "u":
            if value not in ("continue", "eol", "error"):
                raise ValueError(f"format {spec!r}: u is continue, eol or error")
            out = replace(out, unterminated=value)
        elif key == "h":
            out = replace(out, header=_yes(value))
        elif key == "x":
            if value not in ("optional", "required", "forbidden", "ignore"):
                raise ValueError(f"format {spec!r}: x is optional, required, forbidden or ignore")
            out = replace(out, marked=value)
        else:
            raise ValueError(f"format {spec!r}: no key {key!r}")
    return out


#: What a marked header begins with; the delimiter follows it.
MARK = " " + bytes((67, 68, 88)).decode()
