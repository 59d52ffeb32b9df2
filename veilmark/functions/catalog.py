"""Entity types, tags and pattern recognisers, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Types with their tags.
TAGS: dict[str, str] = {
    "PERSON": "PERSON", "ORGANIZATION": "ORG", "LOCATION": "LOCATION", "NRP": "NRP",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "URL": "URL", "IP_ADDRESS": "IP",
    "CREDIT_CARD": "CREDIT_CARD", "IBAN_CODE": "IBAN", "CRYPTO": "CRYPTO",
    "US_SSN": "US_SSN", "US_PASSPORT": "US_PASSPORT", "US_DRIVER_LICENSE": "US_DL",
    "UK_NHS": "UK_NHS", "UK_NIN": "UK_NIN", "UK_PASSPORT": "UK_PASSPORT", "UK_CRN": "UK_CRN", "UK_DRIVING_LICENCE": "UK_DL",
    "EU_VAT": "EU_VAT", "EU_PASSPORT": "EU_PASSPORT", "DE_TAX_ID": "DE_TAX", "DE_SOCIAL_SECURITY": "DE_SSN",
    "FR_NIR": "FR_NIR", "FR_CNI": "FR_CNI", "IT_FISCAL_CODE": "IT_CF", "IT_VAT": "IT_VAT", "ES_DNI": "ES_DNI", "ES_NIE": "ES_NIE",
    "CY_TIC": "CY_TIC", "CY_ID_CARD": "CY_ID", "LEI": "LEI", "ISIN": "ISIN", "CUSIP": "CUSIP", "SWIFT_BIC": "SWIFT", "FINANCIAL_ACCOUNT": "ACCT",
    "NPI": "NPI", "DEA_NUMBER": "DEA", "MEDICARE_ID": "MEDICARE", "MEDICAL_RECORD_NUMBER": "MRN", "MEDICAL_LICENSE": "MED_LIC",
}
NAMED = ("PERSON", "ORGANIZATION", "LOCATION", "NRP")
NOISY = ("NRP", "UK_DRIVING_LICENCE", "EU_VAT", "DE_SOCIAL_SECURITY", "MEDICAL_LICENSE")
DOMAINS = ("legal", "financial", "healthcare", "general")


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    score: float


@dataclass(frozen=True)
class Recogniser:
    """group: always, financial, healthcare, builtin or custom."""

    entity: str
    group: str
    patterns: tuple[Pattern, ...]
    context: tuple[str, ...] = field(default=())


def _r(entity: str, group: str, context: tuple[str, ...], *patterns: tuple[str, str, float]) -> Recogniser:
    return Recogniser(entity, group, tuple(Pattern(n, r"\b" + r + r"\b", s) for n, r, s in patterns), context)


# The body of each member's VAT number behind its prefix, and the score.
VAT = {
    "at": (r"ATU[0-9]{8}", 0.8), "be": (r"BE[01][0-9]{9}", 0.8), "bg": (r"BG[0-9]{9,10}", 0.8), "cy": (r"CY[0-9]{8}[A-Z]", 0.8), "cz": (r"CZ[0-9]{8,10}", 0.8),
    "de": (r"DE[0-9]{9}", 0.8), "dk": (r"DK[0-9]{8}", 0.8), "ee": (r"EE[0-9]{9}", 0.8), "es": (r"ES[A-Z0-9][0-9]{7}[A-Z0-9]", 0.8), "fi": (r"FI[0-9]{8}", 0.8),
    "fr": (r"FR[A-Z0-9]{2}[0-9]{9}", 0.8), "el": (r"EL[0-9]{9}", 0.8), "hr": (r"HR[0-9]{11}", 0.8), "hu": (r"HU[0-9]{8}", 0.8), "ie": (r"IE[0-9][A-Z0-9+*][0-9]{5}[A-Z]", 0.8),
    "it": (r"IT[0-9]{11}", 0.8), "lt": (r"LT[0-9]{9,12}", 0.8), "lu": (r"LU[0-9]{8}", 0.8), "lv": (r"LV[0-9]{11}", 0.8), "mt": (r"MT[0-9]{8}", 0.8),
    "nl": (r"NL[0-9]{9}B[0-9]{2}", 0.8), "pl": (r"PL[0-9]{10}", 0.8), "pt": (r"PT[0-9]{9}", 0.8), "ro": (r"RO[0-9]{2,10}", 0.7), "se": (r"SE[0-9]{12}", 0.8),
    "si": (r"SI[0-9]{8}", 0.8), "sk": (r"SK[0-9]{10}", 0.8), "gb": (r"GB[0-9]{9}", 0.7), "ch": (r"CHE[0-9]{9}", 0.8),
}

# Recognisers with their patterns, base scores and context words. Digits are written [0-9], as \d means more in some engines.
RECOGNISERS: tuple[Recogniser, ...] = (
    _r("UK_NIN", "always", ("national insurance", "NI number", "NIN", "NINO", "tax", "HMRC", "PAYE",), ("uk_nin_spaced", r"[A-CEGHJ-PR-TW-Z]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[A-D]", 0.7)),
    _r("UK_PASSPORT", "always", ("passport", "travel document", "UK passport", "HM Passport", "HMPO",), ("uk_passport", r"[0-9]{9}", 0.1)),
    _r("UK_CRN", "always", ("company number", "registration number", "Companies House", "CRN", "registered number",), ("uk_crn_numeric", r"[0-9]{8}", 0.1), ("uk_crn_alpha", r"[A-Z]{2}[0-9]{6}", 0.4)),
    _r("UK_DRIVING_LICENCE", "always", ("driving licence", "driver's licence", "DVLA", "driving license",), ("uk_dl", r"[A-Z]{5}[0-9]{6}[A-Z0-9]{2}[0-9]{2}[A-Z]{2}", 0.75)),
    _r("UK_NHS", "always", ("NHS number", "NHS", "national health", "patient number",), ("uk_nhs", r"[0-9]{3}\s?[0-9]{3}\s?[0-9]{4}", 0.5)),
    _r("DE_TAX_ID", "always", ("Steuer-ID", "Steueridentifikationsnummer", "tax identification", "IdNr", "TIN", "Finanzamt",), ("de_tax_id", r"[0-9]{11}", 0.1)),
    _r("DE_SOCIAL_SECURITY", "always", ("Sozialversicherungsnummer", "SV-Nummer", "social security", "Rentenversicherung",), ("de_sv", r"[0-9]{2}\s?[0-9]{6}\s?[A-Z]\s?[0-9]{2}\s?[0-9]", 0.6)),
    _r("FR_NIR", "always", ("NIR", "INSEE", "sécurité sociale", "social security", "carte vitale",), ("fr_nir", r"[12]\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{2}\s?[0-9]{3}\s?[0-9]{3}\s?[0-9]{2}", 0.65)),
    _r("FR_CNI", "always", ("carte nationale", "CNI", "national identity", "carte d'identité",), ("fr_cni", r"[0-9]{12}", 0.1)),
    _r("IT_FISCAL_CODE", "always", ("codice fiscale", "fiscal code", "CF", "Italian tax",), ("it_cf", r"[A-Z]{6}[0-9]{2}[A-EHLMPR-T][0-9]{2}[A-Z][0-9]{3}[A-Z]", 0.8)),
    _r("IT_VAT", "always", ("partita IVA", "VAT", "P.IVA",), ("it_vat", r"IT\s?[0-9]{11}", 0.75)),
    _r("ES_DNI", "always", ("DNI", "documento nacional", "NIF", "Spanish ID",), ("es_dni", r"[0-9]{8}[A-Z]", 0.6)),
    _r("ES_NIE", "always", ("NIE", "número de identidad de extranjero", "Spanish residence",), ("es_nie", r"[XYZ][0-9]{7}[A-Z]", 0.7)),
    _r("CY_TIC", "always", ("TIC", "tax identification", "Cyprus tax", "αριθμός φορολογικού",), ("cy_tic", r"[0-9]{8}[A-Z]", 0.5)),
    _r("CY_ID_CARD", "always", ("Cyprus ID", "identity card", "ARC number", "ταυτότητα",), ("cy_id", r"[0-9]{6,8}", 0.05)),
    _r("EU_VAT", "always", ("VAT", "TVA", "Mehrwertsteuer", "MwSt", "IVA", "BTW", "tax number", "VAT number",), *((f"vat_{k}", r, s) for k, (r, s) in VAT.items())),
    _r("EU_PASSPORT", "always", ("passport", "travel document", "passeport", "Reisepass", "EU passport",), ("eu_passport_2l7d", r"[A-Z]{2}[0-9]{7}", 0.3), ("eu_passport_1l8d", r"[A-Z][0-9]{8}", 0.3), ("eu_passport_9d", r"[0-9]{9}", 0.1)),
    _r("LEI", "financial", ("LEI", "legal entity identifier", "GLEIF", "entity identifier", "counterparty LEI", "reporting entity",), ("lei_full", r"[A-Z0-9]{18}[0-9]{2}", 0.6)),
    _r("ISIN", "financial", ("ISIN", "international securities", "securities identifier", "instrument code", "security code", "bond", "equity", "stock",), ("isin_full", r"[A-Z]{2}[A-Z0-9]{9}[0-9]", 0.65)),
    _r("CUSIP", "financial", ("CUSIP", "committee on uniform securities", "security identifier", "US security", "bond identifier",), ("cusip_full", r"[A-Z0-9]{8}[0-9]", 0.55)),
    _r("SWIFT_BIC", "financial", ("SWIFT", "BIC", "bank identifier", "SWIFT code", "routing", "correspondent bank", "wire transfer", "SEPA", "intermediary bank",), ("bic_11", r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}[A-Z0-9]{3}", 0.75), ("bic_8", r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}", 0.6)),
    _r("FINANCIAL_ACCOUNT", "financial", ("account number", "account no", "acct no", "account #", "client account", "brokerage account", "portfolio account", "sort code", "routing number", "transit number", "custodian account", "omnibus account",), ("acct_numeric", r"[0-9]{8,12}", 0.1), ("acct_hyphenated", r"[0-9]{4}-[0-9]{4}-[0-9]{4}", 0.5), ("acct_sort_uk", r"[0-9]{2}-[0-9]{2}-[0-9]{2}", 0.3)),
    _r("NPI", "healthcare", ("NPI", "national provider identifier", "provider number", "provider ID", "physician NPI", "billing NPI", "Type 1 NPI", "Type 2 NPI",), ("npi_full", r"[12][0-9]{9}", 0.5)),
    _r("DEA_NUMBER", "healthcare", ("DEA", "DEA number", "DEA registration", "drug enforcement", "controlled substance", "Schedule II", "Schedule III", "prescriber DEA", "DEA license",), ("dea_full", r"[ABCDEFGHJKLMNPRSTUXabcdefghjklmnprstux][A-Za-z9][0-9]{7}", 0.7)),
    _r("MEDICARE_ID", "healthcare", ("Medicare", "Medicare ID", "MBI", "beneficiary identifier", "Medicare number", "Medicare beneficiary", "CMS", "HICN",), ("mbi_new", r"[A-HJ-NP-RT-Z][A-Z0-9]{10}", 0.4), ("hicn_old", r"[0-9]{9}[A-Z]", 0.2)),
    _r("MEDICAL_RECORD_NUMBER", "healthcare", ("MRN", "medical record", "medical record number", "patient ID", "patient number", "chart number", "encounter number", "hospital number", "registration number",), ("mrn_numeric", r"[0-9]{6,10}", 0.1), ("mrn_prefixed", r"MRN[-:\s]?[0-9]{5,10}", 0.8), ("mrn_prefixed2", r"MR[-:\s]?[0-9]{5,10}", 0.7)),
    _r("MEDICAL_LICENSE", "healthcare", ("medical license", "license number", "state license", "physician license", "medical board", "licensure", "DEA license", "nursing license",), ("med_lic_state", r"[A-Z]{2}[0-9]{5,8}", 0.3), ("med_lic_generic", r"[A-Z][0-9]{6,8}", 0.2)),
)

#: Structured types for which only the names are given; the patterns are this engine's own.
BUILTIN: tuple[Recogniser, ...] = (
    _r("EMAIL_ADDRESS", "builtin", ("email", "e-mail", "mail",), ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 1.0)),
    _r("PHONE_NUMBER", "builtin", ("phone", "telephone", "tel", "mobile", "call", "fax",), ("phone_plus", r"[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", 0.75), ("phone_us", r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}", 0.7)),
    _r("URL", "builtin", ("website", "url", "link",), ("url", r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][A-Za-z0-9_%.~/?=&#:,;!$+@-]*[A-Za-z0-9_])?", 0.85)),
    _r("IP_ADDRESS", "builtin", ("ip", "address", "host",), ("ipv4", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])", 0.6)),
    _r("CREDIT_CARD", "builtin", ("credit", "card", "visa", "mastercard", "amex",), ("card", r"(?:4[0-9]{3}|5[0-5][0-9]{2}|6[0-9]{3}|3[0-9]{3})[- ]?[0-9]{3,4}[- ]?[0-9]{3,4}[- ]?[0-9]{3,5}", 0.6)),
    _r("IBAN_CODE", "builtin", ("iban", "bank", "account",), ("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", 0.7)),
    _r("CRYPTO", "builtin", ("wallet", "bitcoin", "btc", "crypto",), ("btc", r"(?:bc1[a-z0-9]{25,59}|[13][1-9A-HJ-NP-Za-km-z]{25,33})", 0.6)),
    _r("US_SSN", "builtin", ("ssn", "social security",), ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.6)),
    _r("US_PASSPORT", "builtin", ("passport", "travel document",), ("us_passport", r"[A-Z][0-9]{8}", 0.1)),
    _r("US_DRIVER_LICENSE", "builtin", ("driver", "license", "permit",), ("us_dl", r"[A-Z][0-9]{7,12}", 0.3)),
)

# Words that the all-words rule passes over, look-alike letters, articles, words of structural references.
SKIP_WORDS = "the a an of and or for in to by on at is it as if so no not its this that with from but all any each such than into upon per via re vs".split()
LOOK_ALIKE = ("СсАаЕеОоРрХхВвМмТтНн", "CcAaEeOoPpXxBbMmTtHh")
ARTICLES = ("the ", "a ", "an ")
STRUCTURAL = r"^(schedule|clause|section|article|appendix|annex|exhibit|part|recital)\s+[0-9]"

#: Words by domain that are no personal data, this engine's own; further ones are a parameter (see operators.lists).
STOP_TERMS: dict[str, tuple[str, ...]] = {
    "legal": tuple("""client customer vendor supplier contractor subcontractor licensor licensee lessor lessee tenant landlord borrower lender guarantor buyer
seller purchaser assignor assignee transferor transferee grantor grantee trustee beneficiary executor claimant defendant plaintiff respondent appellant petitioner
arbitrator mediator witness counsel solicitor barrister attorney notary judge court tribunal party parties agreement contract deed lease licence license amendment
addendum clause section schedule exhibit appendix annex article recital preamble definition obligation warranty indemnity liability damages remedy breach default
termination notice consent waiver assignment novation confidentiality jurisdiction arbitration governing law statute regulation act order judgment injunction
settlement claim dispute proceedings purchase sale invoice payment fee deposit price delivery services goods works premises property director secretary shareholder
company corporation partnership affiliate subsidiary agent principal employee employer representative signatory effective date term territory force majeure""".split()),
    "financial": tuple("""issuer bond equity share shares stock dividend coupon maturity yield portfolio custodian broker dealer fund trustee account balance statement invoice purchase
payment interest principal collateral margin loan facility credit debit deposit withdrawal transfer transaction settlement clearing exchange market index
security securities derivative option future swap forward warrant note notes debenture debt asset assets liability liabilities revenue income profit loss expense
cost budget forecast audit auditor accountant accounting ledger journal tax rate currency hedge risk exposure limit covenant default rating benchmark
counterparty investor shareholder lender borrower guarantor underwriter arranger agent bank branch treasury capital reserve provision premium discount fee commission
quarter month annual report prospectus offering tranche mortgage pension insurance policy claim beneficiary wire routing reference""".split()),
    "healthcare": tuple("""patient physician doctor nurse midwife surgeon consultant specialist pharmacist therapist dentist radiologist hospital clinic ward theatre pharmacy
laboratory practice department emergency outpatient inpatient admission discharge referral appointment visit consultation diagnosis prognosis treatment prescription
medication dosage dose tablet capsule injection infusion vaccine surgery procedure operation therapy rehabilitation screening test scan biopsy imaging
ultrasound blood urine sample result report record chart note history examination symptom complaint condition disease disorder syndrome infection injury allergy
fever pain cough nausea fatigue hypertension diabetes asthma anxiety depression chronic acute benign malignant provider insurer coverage claim
copay deductible consent guardian caregiver family follow-up plan care unit bed room""".split()),
}


def recognisers(domain: str = "general", custom: tuple[Recogniser, ...] = (), types: tuple[str, ...] | None = None) -> tuple[Recogniser, ...]:
    """Those of a domain: the European set and the structured types always; the financial and healthcare sets for their own domain, general and all."""
    groups = {"always", "builtin", "custom"} | {g for g in ("financial", "healthcare") if domain.lower() in (g, "general", "all")}
    by_name: set[str] = set()
    out = []
    for r in (*RECOGNISERS, *BUILTIN, *custom):
        names = {p.name for p in r.patterns}
        if r.group in groups and (types is None or r.entity in types) and not (r.group == "custom" and names & by_name):
            out.append(r)
            by_name |= names
    return tuple(out)


def stop_terms(domain: str = "general", custom: tuple[str, ...] = (), learned: dict[str, tuple[str, ...]] | None = None) -> list[str]:
    """The domain's terms (all domains' for general, all and unknown ones), custom ones, and learned ones of general and the domain, in lower case."""
    own = STOP_TERMS.get(domain.lower()) or tuple(t for ts in STOP_TERMS.values() for t in ts)
    more = [t for d in ("general", domain) for t in (learned or {}).get(d, ())]
    return sorted({t.lower() for t in (*own, *custom, *more)})


def recogniser_table(spark: SparkSession, domain: str = "general") -> DataFrame:
    """A row a pattern, as data."""
    rows = [(r.entity, TAGS.get(r.entity, r.entity), r.group, p.name, p.regex, p.score, list(r.context)) for r in recognisers(domain) for p in r.patterns]
    return spark.createDataFrame(rows, "type string, tag string, grp string, pattern string, regex string, score double, context array<string>")


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, g, t in NAMED, t in NOISY) for t, g in TAGS.items()], "type string, tag string, is_named boolean, is_noisy boolean")
