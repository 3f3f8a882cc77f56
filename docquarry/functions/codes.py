"""Code lists of the results' contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO 4217 and ISO 639-1 codes that results may hold, and what a currency is called beside a number.
CURRENCIES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BHD BIF BMD BND BOB BOV BRL BSD BTN BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE "
    "CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW "
    "KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR "
    "PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI UYU "
    "UYW UZS VED VES VND VUV WST XAD XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF XPD XPF XPT XSU XUA YER ZAR ZMW ZWG"
)
LANGUAGES = (
    "aa ab ae af ak am an ar as av ay az ba be bg bi bm bn bo br bs ca ce ch co cr cs cu cv cy da de dv dz ee el en eo es et eu fa ff fi fj fo fr fy ga gd "
    "gl gn gu gv ha he hi ho hr ht hu hy hz ia id ie ig ii ik io is it iu ja jv ka kg ki kj kk kl km kn ko kr ks ku kv kw ky la lb lg li ln lo lt lu lv mg "
    "mh mi mk ml mn mr ms mt my na nb nd ne ng nl nn no nr nv ny oc oj om or os pa pi pl ps pt qu rm rn ro ru rw sa sc sd se sg sh si sk sl sm sn so sq sr "
    "ss st su sv sw ta te tg th ti tk tl tn to tr ts tt tw ty ug uk ur uz ve vi vo wa wo xh yi yo za zh zu"
)
ALIASES = {"zł": "PLN", "złotych": "PLN", "euro": "EUR", "€": "EUR", "$": "USD"}
# End of the fixed values.


def is_currency(code: Column) -> Column:
    # a list of constants becomes a set, in which one code costs one look
    return code.isin(*CURRENCIES.split())


def is_language(code: Column) -> Column:
    return code.isin(*LANGUAGES.split())


def currency_code(marker: Column) -> Column:
    """ISO code of a currency marker, or null."""
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    # no alias is a code in small letters, so codes need no other case
    return F.coalesce(F.element_at(names, marker), F.when(is_currency(marker), marker), F.element_at(names, F.lower(marker)))
