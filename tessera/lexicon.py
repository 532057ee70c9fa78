"""Token lists that the text operators work with. Every lexical operator takes a Lexicon."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """Tokens of a language by role; tokens are matched as plain substrings."""

    routine: tuple[str, ...]
    routine_end: tuple[str, ...]
    condition: tuple[str, ...]
    loop: tuple[str, ...]
    loop_keyword: tuple[str, ...]  # those of `loop` that the debt rules count
    loop_head: str  # the one whose presence makes a loop for the concatenation rule
    operator: tuple[str, ...]
    comment: str
    concat: str = '+ "'


# The script language's own keywords.
SCRIPT = Lexicon(
    routine=("Функция", "Процедура"),
    routine_end=("КонецФункции", "КонецПроцедуры"),
    condition=("Если",),
    loop=("Цикл", "Для", "Пока"),
    loop_keyword=("Цикл", "Для"),
    loop_head="Цикл",
    operator=("=", "+", "-", "И", "ИЛИ"),
    comment="//",
)

#: The same roles for the prose of the driver's tables, so that every branch is exercised.
PROSE = Lexicon(
    routine=("The ", "Un "),
    routine_end=("All rights", "End."),
    condition=(" if ", " in "),
    loop=(" for ", " of ", " en "),
    loop_keyword=(" for ", " of "),
    loop_head=" for ",
    operator=("=", "+", "-", " and ", ","),
    comment="www",
    concat=". ",
)
