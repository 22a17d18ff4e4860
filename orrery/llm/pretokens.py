"""Cutting texts into pre-tokens exactly as a tokenizer's own library does.

Pattern engines know different versions of Unicode. The letters and numbers
that the library's engine knows are read from it once, on the driver; texts
that hold a code point on which the engines differ are cut with a pattern that
leaves those out or takes them in.
"""

from __future__ import annotations

from collections.abc import Callable

CLASSES = ("L", "N")


def all_chars() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def known_to_tiktoken(name: str) -> set[str]:
    import tiktoken

    codec = tiktoken.Encoding("classes", pat_str=rf"\p{{{name}}}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    return set(codec.decode_bytes(codec.encode_ordinary(all_chars())).decode())


def known_to_tokenizers(name: str) -> set[str]:
    from tokenizers import Regex, pre_tokenizers

    left = pre_tokenizers.Split(Regex(rf"\p{{{name}}}"), behavior="removed").pre_tokenize_str(all_chars())
    return set(all_chars()).difference(*(x for x, _ in left))


def ranges(chars: set[str]) -> str:
    found: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in found)


class Splitter:
    """``compiled()`` gives a function from a text to its pre-tokens. Small, so it can be sent to workers."""

    def __init__(self, pattern: str, known: Callable[[str], set[str]] | None = None):
        import regex

        self.pattern = self.careful = pattern
        self.odd: set[str] = set()
        if known is None:
            return
        letter, number = (self.class_of(name, known) for name in CLASSES)
        if self.odd:
            # What is neither space nor letter nor number: a lookahead over the other classes.
            other = r"[^\s\p{L}\p{N}]"
            self.careful = pattern.replace(other, "\0").replace(r"\p{L}", letter).replace(r"\p{N}", number).replace("\0", rf"(?:(?!{letter}|{number})[^\s])")

    def class_of(self, name: str, known: Callable[[str], set[str]]) -> str:
        import regex

        own, theirs = set(regex.findall(rf"\p{{{name}}}", all_chars())), known(name)
        less, more = ranges(own - theirs), ranges(theirs - own)
        self.odd |= own ^ theirs
        inside = f"[\\p{{{name}}}{more}]"
        return f"[{inside}--[{less}]]" if less else inside

    def compiled(self) -> Callable[[str], list[str]]:
        import regex

        plain = regex.compile(self.pattern).findall
        if not self.odd:
            return plain
        careful, odd = regex.compile(self.careful, regex.V1).findall, self.odd

        def cut(text: str) -> list[str]:
            if text.isascii():
                return plain(text)
            try:
                text.encode("latin-1")  # no class differs there
            except UnicodeEncodeError:
                if not odd.isdisjoint(text):
                    return careful(text)
            return plain(text)

        return cut
