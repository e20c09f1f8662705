"""Product identity, prices and currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import strip

# Currency codes of ISO 4217 in use.
CURRENCIES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR "
    "FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR "
    "MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD "
    "TWD TZS UAH UGX USD USN UYI UYU UYW UZS VED VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWG"
).split()
DEFAULT_CURRENCY = "JOD"
PRICE = "decimal(12,3)"


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def crawl_identity(name: Column, mpn: Column, class_name: Column, url: Column) -> Column:
    """SCA-17: ``mpn:`` and the number without hyphens, blanks and dots in upper case; else ``fallback:`` and a digest of name, class and address."""
    number = F.nullif(F.upper(F.regexp_replace(mpn, r"[\-\s.]", "")), F.lit(""))
    parts = F.concat_ws("|", F.coalesce(F.lower(strip(name)), F.lit("")), F.coalesce(class_name, F.lit("")), F.coalesce(url, F.lit("")))
    return F.coalesce(F.concat(F.lit("mpn:"), number), F.concat(F.lit("fallback:"), F.sha2(parts, 256)))


def upload_identity(item_no: Column, mpn: Column, name: Column) -> Column:
    """SCA-18: item number, else part number, else name."""
    return F.coalesce(blank_to_null(item_no), blank_to_null(mpn), blank_to_null(name))


def identity_token(c: Column) -> Column:
    """SCA-19."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def upload_price(c: Column) -> Column:
    """SCA-20: commas are dropped."""
    return strip(F.replace(c, F.lit(","), F.lit(""))).try_cast(PRICE)


def page_price(c: Column) -> Column:
    """SCA-21: not negative; commas are not understood."""
    price = strip(c).try_cast(PRICE)
    return F.when(price >= 0, price)


def currency(c: Column) -> Column:
    """SCA-22: a known code in upper case, else null."""
    code = F.upper(strip(c))
    return F.when(code.isin(*CURRENCIES), code)


def first_offer(offers: Column) -> Column:
    """SCA-23: the first offer whose price and currency are both valid."""
    return F.get(F.filter(offers, lambda o: page_price(o["price"]).isNotNull() & currency(o["currency"]).isNotNull()), F.lit(0))


def identity_hint(mpn: Column, sku: Column, name: Column) -> Column:
    """SCA-24."""
    return F.coalesce(blank_to_null(mpn), blank_to_null(sku), blank_to_null(name))


def guessed_class(name: Column, classes: Column) -> Column:
    """SCA-25: the first class whose name is part of the product's, without regard to case."""
    return F.get(F.filter(classes, lambda c: F.lower(name).contains(F.lower(c))), F.lit(0))


def chunk_key(version: Column, model: Column, text: Column) -> Column:
    """SRC-16: the key under which a chunk's answer is kept."""
    return F.sha2(F.concat_ws("|", version, model, text), 256)
