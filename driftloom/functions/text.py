"""Realistic text as lookups in small vocabularies, keyed by draws.

No Python runs per row.  Methods that are not listed in ``PROVIDERS`` go to the Faker
package where it is installed, with a call of it for each row: a fallback for few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftloom.functions.draws import Draws

_FIRST = "Ada Bruno Chiara Dmitri Elena Farid Greta Hugo Ines Jonas Kira Lukas Mina Noor Otto Paula Quinn Rosa Samir Tilda Ugo Vera Wanda Xenia Yusuf Zoe".split()
_LAST = "Abbott Brandt Castillo Duarte Eriksen Fontaine Gruber Haddad Ivanov Jansen Keller Lindqvist Moreau Novak Okafor Petit Quist Rossi Schulz Tanaka Ueda Vargas Weiss Xu Yilmaz Zeller".split()
_CITY = "Ashford Brookhaven Clearwater Dunmore Eastvale Fairmont Glenwood Harborview Ironbridge Juniper Kingsport Lakemont Millbrook Northfield Oakridge Pinehurst".split()
_STREET = "Alder Birch Cedar Dogwood Elm Foundry Garden Harbor Iris Juniper Lantern Maple Orchard Quarry River Spruce".split()
_KIND = "Street Avenue Road Lane Court Way".split()
_FIRM = "Aurora Beacon Cobalt Delta Ember Fathom Granite Helio Ionic Juno Krypton Lumen Meridian Nimbus Orbit Pinnacle".split()
_FIRM_KIND = "Group Labs Partners Works Systems Industries".split()
_WORD = (
    "amber bridge candle distant early field gentle harbor island journey kitchen ladder meadow narrow open paper quiet "
    "river silver tunnel under valley window yellow autumn bottle copper drift engine forest garden hollow"
).split()


def _choice(words: list[str], draws: Draws, path: str, role: str) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), draws.index(len(words), path, role) + 1)


def _first(d: Draws, p: str, a: dict) -> Column:
    return _choice(_FIRST, d, p, "first")


def _last(d: Draws, p: str, a: dict) -> Column:
    return _choice(_LAST, d, p, "last")


def _name(d: Draws, p: str, a: dict) -> Column:
    return F.concat_ws(" ", _first(d, p, a), _last(d, p, a))


def _user(d: Draws, p: str, a: dict) -> Column:
    number = d.index(100, p, "number").cast("string")
    return F.concat(F.lower(_first(d, p, a)), F.lit("_"), F.lower(_last(d, p, a)), number)


def _email(d: Draws, p: str, a: dict) -> Column:
    return F.concat(_user(d, p, a), F.lit("@example."), _choice(["com", "org", "net"], d, p, "domain"))


def _firm(d: Draws, p: str, a: dict) -> Column:
    return F.concat_ws(" ", _choice(_FIRM, d, p, "firm"), _choice(_FIRM_KIND, d, p, "firm_kind"))


def _firm_email(d: Draws, p: str, a: dict) -> Column:
    return F.concat(F.lower(_first(d, p, a)), F.lit("."), F.lower(_last(d, p, a)), F.lit("@"), F.lower(_choice(_FIRM, d, p, "firm")), F.lit(".example.com"))


def _digits(n: int, d: Draws, p: str, role: str) -> Column:
    return F.lpad(F.floor(d.uniform(p, role) * float(10**n)).cast("string"), n, "0")


def _address(d: Draws, p: str, a: dict) -> Column:
    number = (d.index(9999, p, "number") + 1).cast("string")
    return F.concat_ws(" ", number, _choice(_STREET, d, p, "street"), _choice(_KIND, d, p, "kind"))


def _phone(d: Draws, p: str, a: dict) -> Column:
    return F.concat(F.lit("(555) "), _digits(3, d, p, "exchange"), F.lit("-"), _digits(4, d, p, "line"))


def _url(d: Draws, p: str, a: dict) -> Column:
    return F.concat(F.lit("https://"), F.lower(_choice(_FIRM, d, p, "firm")), F.lit(".example.com/"), _choice(_WORD, d, p, "page"))


def _words(n: int, d: Draws, p: str, role: str) -> Column:
    return F.concat_ws(" ", *(_choice(_WORD, d, p, f"{role}{k}") for k in range(n)))


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1_000_000))


def _sentence(d: Draws, p: str, a: dict, role: str = "w") -> Column:
    return F.concat(_capital(_words(max(1, int(a.get("nb_words", 6))), d, p, role)), F.lit("."))


def _paragraph(d: Draws, p: str, a: dict) -> Column:
    return F.concat_ws(" ", *(_sentence(d, p, {}, f"s{k}w") for k in range(max(1, int(a.get("nb_sentences", 3))))))


def _text(d: Draws, p: str, a: dict) -> Column:
    most = max(5, int(a.get("max_nb_chars", 200)))
    # every word and its gap has four characters at least, seven and a bit on average
    long = _capital(_words(most // 5 + 2, d, p, "t"))
    return F.concat(F.regexp_extract(long, rf"^(.{{1,{most - 1}}})(?:\s|$)", 1), F.lit("."))


def _card(d: Draws, p: str, a: dict) -> Column:
    body = F.concat(F.lit("4"), _digits(14, d, p, "card"))
    total = None
    for k in range(15):
        digit = F.substring(body, k + 1, 1).cast("int")
        if k % 2 == 0:
            digit = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        total = digit if total is None else total + digit
    return F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


PROVIDERS: dict[str, Callable[[Draws, str, dict], Column]] = {
    "name": _name,
    "first_name": _first,
    "last_name": _last,
    "email": _email,
    "ascii_company_email": _firm_email,
    "street_address": _address,
    "city": lambda d, p, a: _choice(_CITY, d, p, "city"),
    "zipcode": lambda d, p, a: _digits(5, d, p, "zip"),
    "phone_number": _phone,
    "sentence": _sentence,
    "paragraph": _paragraph,
    "text": _text,
    "user_name": _user,
    "url": _url,
    "company": _firm,
    "credit_card_number": _card,
    "word": lambda d, p, a: _choice(_WORD, d, p, "word"),
}


def provide(method: str, args: dict[str, Any], draws: Draws, path: str) -> Column:
    """Text of a provider's method."""
    if method in PROVIDERS:
        return PROVIDERS[method](draws, path, args)
    return _through_faker(method, args, draws, path)


def _through_faker(method: str, args: dict[str, Any], draws: Draws, path: str) -> Column:
    try:
        from faker import Faker
    except ImportError as error:
        raise ImportError(f"the text provider {method!r} needs the Faker package") from error
    if not hasattr(Faker(), method):
        raise AttributeError(f"Faker has no method {method!r}")
    import pandas as pd

    @F.pandas_udf("string")
    def speak(seeds: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fake = Faker()

        def one(seed: int) -> str:
            fake.seed_instance(int(seed))
            return str(getattr(fake, method)(**args))

        for batch in seeds:
            yield batch.map(one)

    return speak(F.floor(draws.uniform(path, "seed") * float(1 << 48)).cast("long"))
