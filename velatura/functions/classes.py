"""Character classes that mean the same in Java regular expressions as the Unicode classes of the labelled data's tools."""

#: Letters, numbers and the underscore; decimal digits; white space, with the separators that Java's own class leaves out.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A change between word and other characters, as a zero-width pattern.
EDGE = rf"(?:(?<![{WORD}])(?=[{WORD}])|(?<=[{WORD}])(?![{WORD}]))"


def unicode(pattern: str) -> str:
    """A pattern written with \\w \\d \\s \\b, outside or inside brackets, over the classes above."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            kind = pattern[i + 1]
            known = {"w": WORD, "d": DIGIT, "s": SPACE}.get(kind)
            if known:
                out.append(known if inside else f"[{known}]")
            elif kind == "b" and not inside:
                out.append(EDGE)
            elif kind == "S" and not inside:
                out.append(f"[^{SPACE}]")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return "".join(out)
