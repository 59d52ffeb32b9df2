"""Each pattern of the catalogue on a text that it must find and one that it must not, written by hand."""

import re

import pytest

from veilmark.functions.catalog import BUILTIN, RECOGNISERS
from veilmark.operators.recognise import Context, boosted, words_before

CASES = {
    "uk_nin_spaced": ("AB 12 34 56 C", "QB123456E"),
    "uk_passport": ("123456789", "12345678"),
    "uk_crn_numeric": ("01234567", "1234567"),
    "uk_crn_alpha": ("SC123456", "S1234567"),
    "uk_dl": ("MORGA657054SM91IJ", "MORGA657054SM9IJ"),
    "uk_nhs": ("943 476 5919", "943-476-5919"),
    "de_tax_id": ("12345678901", "1234567890"),
    "de_sv": ("65 070539 M 00 7", "65 070539 7 00 7"),
    "fr_nir": ("1 85 12 75 108 123 42", "3 85 12 75 108 123 42"),
    "fr_cni": ("123456789012", "12345678901"),
    "it_cf": ("RSSMRA85M01H501Z", "RSSMRA85F01H501Z"),
    "it_vat": ("IT 12345678901", "IT1234567890"),
    "es_dni": ("12345678Z", "1234567Z"),
    "es_nie": ("X1234567L", "W1234567L"),
    "cy_tic": ("12345678X", "12345678x"),
    "cy_id": ("123456", "12345"),
    "vat_at": ("ATU12345678", "AT12345678"), "vat_be": ("BE0123456789", "BE2123456789"), "vat_bg": ("BG123456789", "BG12345678"), "vat_cy": ("CY12345678X", "CY123456789"),
    "vat_cz": ("CZ12345678", "CZ1234567"), "vat_de": ("DE123456789", "DE12345678"), "vat_dk": ("DK12345678", "DK1234567"), "vat_ee": ("EE123456789", "EE12345678"),
    "vat_es": ("ESB1234567Q", "ESB123456Q"), "vat_fi": ("FI12345678", "FI1234567"), "vat_fr": ("FRAB123456789", "FR123456789"), "vat_el": ("EL123456789", "GR123456789"),
    "vat_hr": ("HR12345678901", "HR1234567890"), "vat_hu": ("HU12345678", "HU1234567"), "vat_ie": ("IE1A23456B", "IEAA23456B"), "vat_it": ("IT12345678901", "IT1234567890"),
    "vat_lt": ("LT123456789", "LT12345678"), "vat_lu": ("LU12345678", "LU1234567"), "vat_lv": ("LV12345678901", "LV123456789"), "vat_mt": ("MT12345678", "MT1234567"),
    "vat_nl": ("NL123456789B01", "NL123456789C01"), "vat_pl": ("PL1234567890", "PL123456789"), "vat_pt": ("PT123456789", "PT12345678"), "vat_ro": ("RO12", "RO1"),
    "vat_se": ("SE123456789012", "SE12345678901"), "vat_si": ("SI12345678", "SI1234567"), "vat_sk": ("SK1234567890", "SK123456789"), "vat_gb": ("GB123456789", "GB12345678"),
    "vat_ch": ("CHE123456789", "CH123456789"),
    "eu_passport_2l7d": ("AB1234567", "AB123456"), "eu_passport_1l8d": ("C12345678", "C1234567"), "eu_passport_9d": ("123456789", "1234567890"),
    "lei_full": ("5493001KJTIIGC8Y1R12", "5493001KJTIIGC8Y1RAB"),
    "isin_full": ("US0378331005", "US037833100"),
    "cusip_full": ("037833100", "03783310A"),
    "bic_11": ("DEUTDEFF500", "DEUTDEFF5000"), "bic_8": ("DEUTDEFF", "DEUTDEF"),
    "acct_numeric": ("12345678", "1234567"), "acct_hyphenated": ("1234-5678-9012", "1234-5678-901"), "acct_sort_uk": ("12-34-56", "12-34-5"),
    "npi_full": ("1234567890", "3234567890"),
    "dea_full": ("AB1234567", "AB123456"),
    "mbi_new": ("E1G4TE5MK73", "B1G4TE5MK7"), "hicn_old": ("123456789A", "12345678A"),
    "mrn_numeric": ("123456", "12345"), "mrn_prefixed": ("MRN-12345", "MRN-1234"), "mrn_prefixed2": ("MR 12345", "MS 12345"),
    "med_lic_state": ("CA12345", "C12345"), "med_lic_generic": ("D123456", "D12345"),
    "email": ("o.neil+x@mail.example.com", "o.neil@example"), "phone_plus": ("1 (555) 123-4567", "1 555 123"), "phone_us": ("555-123-4567", "555 123 4567"),
    "url": ("https://example.org:8080/a?b=c#d", "https://example"), "ipv4": ("192.168.1.1", "192.168.1"), "card": ("4111-1111-1111-1111", "7111-1111-1111-1111"),
    "iban": ("GB82 WEST 1234 5698 7654 32", "G882 WEST"), "btc": ("1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "0BoatSLRHtKNngkdXEeobR76b53LETtpyT"),
    "ssn": ("123-45-6789", "123-45-678"), "us_passport": ("C12345678", "C1234567"), "us_dl": ("D1234567", "D123456"),
}
PATTERNS = {p.name: p.regex for r in (*RECOGNISERS, *BUILTIN) for p in r.patterns}


def test_all_patterns_have_cases():
    assert set(CASES) == set(PATTERNS)


@pytest.mark.parametrize("name", sorted(CASES))
def test_pattern(name):
    good, bad = CASES[name]
    found = [m[0] for m in re.finditer(PATTERNS[name], f"see {good}, and")]
    assert good in found and good not in [m[0] for m in re.finditer(PATTERNS[name], f"x{good}x")]
    assert bad not in [m[0] for m in re.finditer(PATTERNS[name], f"see {bad}, and")]


def test_long_values():
    for n in (63, 64, 500, 3000):
        for name, value in (("email", "q" * n + "@" + "m" * n + ".example.org"), ("url", "https://example.org/" + "p/" * n + "end"), ("email", "a@" + "b." * n + "org")):
            assert re.search(PATTERNS[name], f"see {value} now")[0] == value


def test_words_before():
    text = "one  two\nTHREE " + "x" * 900 + " four five six seven"
    assert words_before(text, len(text), 4) == "four five six seven"
    assert words_before(text, len(text) - 20, 2) == "three " + "x" * 900
    assert words_before(text, 0, 3) == "" and words_before(text, 5, 3) == "one"
    assert boosted("my account no: " + "z" * 500 + " 1", 516, 0.1, ("account no",), Context()) == pytest.approx(0.45)
