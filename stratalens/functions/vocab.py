"""Vocabularies, patterns and constants of document risk analytics, as data."""

# Keywords of companies' filings (lower case, matched as substrings).
FILING_COUNTRIES = ["china", "india", "japan", "taiwan", "vietnam", "korea", "united states", "usa", "eu", "europe", "uk", "germany"]
FILING_OPERATIONS = ["manufacturing", "production", "supply chain", "operations", "factory", "plant"]
FILING_RISKS = {
    "Tariff/Trade": ["tariff", "trade war", "trade dispute", "trade restriction", "import", "export restriction"],
    "Regulatory": ["regulation", "regulatory change", "compliance", "regulatory risk", "new regulation"],
    "Supply Chain": ["supply chain", "supplier risk", "sourcing risk", "manufacturing disruption"],
    "Market": ["market risk", "competitive", "competition", "market condition"],
    "Currency/FX": ["currency risk", "foreign exchange", "fx risk", "exchange rate", "currency fluctuation"],
    "Technology": ["cybersecurity", "data breach", "privacy risk", "technology risk", "cyber attack"],
    "Geopolitical": ["geopolitical", "political risk", "sanctions", "embargo", "political uncertainty"],
    "Climate/Environmental": ["climate", "environmental risk", "carbon", "sustainability risk", "climate change"],
    "Credit/Financial": ["credit risk", "financial risk", "liquidity risk", "debt risk", "financial condition"],
}

# What chunks and regulations are tagged with.
REGIONS = {
    "China": ["China", "Chinese", "PRC", "mainland"],
    "United States": ["United States", "U.S.", "USA", "America"],
    "EU": ["European Union", "EU", "Europe", "EUR"],
    "Japan": ["Japan", "Japanese", "JP"],
    "Taiwan": ["Taiwan", "Taiwanese"],
    "Vietnam": ["Vietnam", "Vietnamese"],
    "India": ["India", "Indian"],
}
OPERATIONS = {
    "Manufacturing": ["manufacturing", "production", "assembly", "factory", "plant"],
    "Supply Chain": ["supply chain", "supplier", "vendor", "sourcing"],
    "Distribution": ["distribution", "distribution channel", "retail", "wholesale"],
    "Research": ["research", "development", "r&d", "rd"],
    "Sales": ["sales", "revenue", "market", "customer"],
}
RISKS = {
    "Tariff/Trade": ["tariff", "trade", "customs", "duty"],
    "Supply Chain": ["supply chain", "supplier", "logistics"],
    "Regulatory": ["regulation", "compliance", "regulatory"],
    "Political": ["political", "geopolitical", "government", "embargo"],
    "Currency": ["currency", "exchange rate", "forex"],
    "Export/Import": ["export", "import", "restriction"],
}
AREAS = {
    "Technology": ["technology", "semiconductor", "chip", "electronic"],
    "Manufacturing": ["manufacturing", "production", "industrial"],
    "Consumer Goods": ["consumer", "product", "smartphone", "device"],
    "Financial": ["financial", "banking", "payment"],
    "Energy": ["energy", "power", "electric"],
}

# What company profiles are tagged with.
PROFILE_REGIONS = {
    "China": ["china", "chinese"], "Japan": ["japan", "japanese"], "Germany": ["germany", "german"],
    "United Kingdom": ["united kingdom", "uk"], "France": ["france", "french"], "India": ["india", "indian"],
    "South Korea": ["south korea", "korea"], "Taiwan": ["taiwan"], "Vietnam": ["vietnam"], "Brazil": ["brazil"],
    "Canada": ["canada"], "Mexico": ["mexico"],
}
PROFILE_OPERATIONS = {
    "Manufacturing": ["manufacturer", "production", "factory", "plant"],
    "Research": ["research", "development", "r&d", "innovation"],
    "Supply Chain": ["supply chain", "supplier", "sourcing", "vendor"],
    "Distribution": ["distribution", "retail", "wholesale", "sales channel"],
    "Services": ["service", "consulting", "support"],
    "Technology": ["software", "technology", "platform", "digital"],
}
PROFILE_RISKS = {
    "Tariff/Trade": ["tariff", "trade", "import", "export", "trade war", "trade dispute"],
    "Regulatory": ["regulation", "regulatory", "compliance", "regulatory change"],
    "Supply Chain": ["supply chain", "supplier", "sourcing", "manufacturing risk"],
    "Market": ["market risk", "competition", "competitive", "market condition"],
    "Currency/FX": ["currency", "foreign exchange", "fx risk", "exchange rate"],
    "Technology": ["cybersecurity", "data breach", "privacy", "technology risk"],
    "Geopolitical": ["geopolitical", "political risk", "sanctions", "embargo"],
    "Climate/Environmental": ["climate", "environmental", "carbon", "sustainability risk"],
    "Credit/Financial": ["credit risk", "financial risk", "liquidity", "debt"],
}

# Section headers by filing type (pattern, id, title).
_RISK_FACTORS = (r"ITEM\s+1A\.?\s*[:\-&#;\s]*RISK\s+FACTORS", "item_1a", "Item 1A. Risk Factors")
_BUSINESS = (r"ITEM\s+1\.?\s*(?:[:\-&#;\s]+(?:BUSINESS|AND\s+RESULTS\s+OF\s+OPERATIONS)|(?![A-Z]))", "item_1", "Item 1. Business")
SECTIONS = {
    "10-K": [
        _RISK_FACTORS,
        (r"ITEM\s+1\.?\s*(?:[:\-&#;\s]|$)(?![A-Z])", "item_1", "Item 1. Business"),
        (r"ITEM\s+3\.?\s*[:\-&#;\s]*(?:LEGAL|PROCEEDINGS)", "item_3", "Item 3. Legal Proceedings"),
        (r"ITEM\s+7\.?\s*[:\-&#;\s]*(?:MANAGEMENT[^A]|MD&A|MD\s*&amp;\s*A|DISCUSSION)", "item_7", "Item 7. Management's Discussion and Analysis"),
        (r"ITEM\s+9A\.?\s*[:\-&#;\s]", "item_9a", "Item 9A. Controls and Procedures"),
    ],
    "10-Q": [
        _RISK_FACTORS,
        (r"ITEM\s+2\.?\s*[:\-&#;\s]*PROPERTIES", "item_2", "Item 2. Properties"),
        (r"ITEM\s+4\.?\s*[:\-&#;\s]*(?:MINE|CONTROLS)", "item_4", "Item 4. Controls and Procedures"),
    ],
    "8-K": [
        (r"ITEM\s+1\.01\.?\s*[:\-&#;\s]*(?:ENTRY|MATERIAL|DEFINITIVE)", "item_1.01", "Item 1.01 Entry into Material Definitive Agreement"),
        (r"ITEM\s+1\.02\.?\s*[:\-&#;\s]*(?:TERMINATION|MATERIAL|DEFINITIVE)", "item_1.02", "Item 1.02 Termination of Material Definitive Agreement"),
        (r"ITEM\s+3\.01\.?\s*[:\-&#;\s]*(?:NOTICE|DELISTING|FAILURE)", "item_3.01", "Item 3.01 Notice of Delisting or Failure to Satisfy Listing Rule"),
        (r"ITEM\s+4\.01\.?\s*[:\-&#;\s]*(?:CHANGES|CERTIFYING|ACCOUNTANT)", "item_4.01", "Item 4.01 Changes in Registrant's Certifying Accountant"),
        (r"ITEM\s+4\.02\.?\s*[:\-&#;\s]*(?:NON-?RELIANCE|PREVIOUSLY|FINANCIAL)", "item_4.02", "Item 4.02 Non-Reliance on Previously Issued Financial Statements"),
        (r"ITEM\s+5\.02\.?\s*[:\-&#;\s]*(?:DEPARTURE|DIRECTORS|PRINCIPAL|OFFICERS)", "item_5.02", "Item 5.02 Departure of Directors or Principal Officers"),
        (r"ITEM\s+8\.01\.?\s*[:\-&#;\s]*(?:OTHER\s+EVENTS?)", "item_8.01", "Item 8.01 Other Events"),
    ],
    "": [_RISK_FACTORS, _BUSINESS],
}
FALLBACK_SECTIONS = [
    _RISK_FACTORS,
    _BUSINESS,
    (r"ITEM\s+7A\.?\s*[:\-&#;\s]*QUANTITATIVE", "item_7a", "Item 7A. Quantitative and Qualitative Disclosures"),
    (r"ITEM\s+7\.?\s*[:\-&#;\s]*(?:MANAGEMENT[^A]|MD&A|MD\s*&amp;\s*A)", "item_7", "Item 7. Management's Discussion and Analysis"),
    (r"ITEM\s+8\.?\s*[:\-&#;\s]*FINANCIAL", "item_8", "Item 8. Financial Statements"),
    (r"ITEM\s+2\.?\s*[:\-&#;\s]*PROPERTIES", "item_2", "Item 2. Properties"),
    (r"ITEM\s+3\.?\s*[:\-&#;\s]*LEGAL", "item_3", "Item 3. Legal Proceedings"),
    (r"ITEM\s+4\.?\s*[:\-&#;\s]*MINE", "item_4", "Item 4. Mine Safety Disclosures"),
    (r"ITEM\s+5\.?\s*[:\-&#;\s]*MARKET", "item_5", "Item 5. Market for Registrant's Common Equity"),
    (r"ITEM\s+6\.?\s*[:\-&#;\s]*SELECTED", "item_6", "Item 6. Selected Financial Data"),
]

# Official identifiers of legislation (pattern, type, jurisdiction), phrases and file names.
IDENTIFIERS = [
    (r"REGULATION\s*\(EU\)\s*(\d{4}/\d+)", "regulation", "EU"),
    (r"DIRECTIVE\s*\(EU\)\s*(\d{4}/\d+)", "directive", "EU"),
    (r"(H\.R\.\s*\d+)", "bill", "US"),
    (r"(S\.\s*\d+)", "bill", "US"),
    (r"Public\s+Law\s+(\d+-\d+)", "law", "US"),
    ("(中华人民共和国[一-龥]+法)", "law", "CN"),
    (r"(法律第\d+号)", "law", "JP"),
]
JURISDICTION_PHRASES = [("EU", ["European Union", "European Parliament", "Member States"]), ("US", ["United States", "Congress", "enacted by"]), ("CN", ["中华人民共和国", "全国人民代表大会"]), ("JP", ["日本国"])]
JURISDICTION_FILES = [("EU", ["REGULATION", "DIRECTIVE"]), ("US", ["H.R."]), ("CN", ["中华人民共和国"]), ("JP", ["人工知能", "法律"])]

# Relations between companies and places in prose.
RELATIONS = [(r"(?is)manufactur.*?in\s+([A-Z][a-z]+)", "MANUFACTURES_IN"), (r"(?is)operat.*?in\s+([A-Z][a-z]+)", "OPERATES_IN"), (r"(?is)supply.*?chain.*?in\s+([A-Z][a-z]+)", "SUPPLY_CHAIN_IN")]

# Weights and bands of the risk score.
SECTION_WEIGHTS = {"risk_factors": 1.0, "significant_events": 0.95, "business": 0.6, "other": 0.5}
IMPACT_WEIGHTS = {"risk_factors": 1.5, "business": 1.2, "significant_events": 1.0, "other": 0.8}
RISK_BANDS = [(0.75, "critical"), (0.5, "high"), (0.2, "medium")]
RECENCY_RATE, TOKENS_BASE, HIGH_RISK_COUNTRIES = 0.001, 1000, ["china", "taiwan", "vietnam", "india", "south korea"]

# How text is cleaned, step by step (pattern, what takes its place). $1 is a group.
CLEANING = [
    (r"(?U)\n(?:\s*\n+)?", " "),
    (r"([.!?])([A-Za-z])", "$1 $2"),
    (r" +", " "),
    (r"""(?U)[^\w\s.,;:!?\-()"'%$£€]""", ""),
    (r"(?U)(?<=[a-z])(?=[A-Z])|(?<=\d)(?=[A-Za-z])", " "),
    (r" +", " "),
    (r"(?U)^\s+|\s+$", ""),
]

# Headers of filings in plain text (tags already out), as SECTIONS are in markup.
PLAIN_SECTIONS = [
    (r"ITEM\s+1A\.?\s*[:\-]?\s*RISK\s+FACTORS", "item_1a", "Item 1A. Risk Factors"),
    (r"ITEM\s+1\.?\s*[:\-]?\s*BUSINESS", "item_1", "Item 1. Business"),
    (r"ITEM\s+7A\.?\s*[:\-]?\s*QUANTITATIVE", "item_7a", "Item 7A. Quantitative and Qualitative Disclosures"),
    (r"ITEM\s+7\.?\s*[:\-]?\s*MANAGEMENT[^A]", "item_7", "Item 7. Management's Discussion and Analysis"),
    (r"ITEM\s+8\.?\s*[:\-]?\s*FINANCIAL", "item_8", "Item 8. Financial Statements"),
    (r"ITEM\s+2\.?\s*[:\-]?\s*PROPERTIES", "item_2", "Item 2. Properties"),
    (r"ITEM\s+3\.?\s*[:\-]?\s*LEGAL", "item_3", "Item 3. Legal Proceedings"),
    (r"ITEM\s+4\.?\s*[:\-]?\s*MINE", "item_4", "Item 4. Mine Safety Disclosures"),
    (r"ITEM\s+5\.?\s*[:\-]?\s*MARKET", "item_5", "Item 5. Market for Registrant's Common Equity"),
    (r"ITEM\s+6\.?\s*[:\-]?\s*SELECTED", "item_6", "Item 6. Selected Financial Data"),
]

# Where a filing's company and its CIK are looked for, in this order.
COMPANY_TITLE = r"(?is)<title[^>]*>([^<]+)</title>"
COMPANY_TITLE_END = r"(?i)\s*[-|]\s*(10-[KQ]|8-K|SEC.*?Filing).*$"
COMPANY_META = [
    r"""(?i)<meta[^>]*name=["']company["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]*property=["']og:site_name["'][^>]*content=["']([^"']+)["']""",
    r"""(?i)<meta[^>]*content=["']([^"']+)["'][^>]*name=["']company["']""",
]
COMPANY_ELEMENTS = [
    r"""(?i)<div[^>]*class=["'][^"']*company[^"']*["'][^>]*>([^<]+)</div>""",
    r"""(?i)<span[^>]*class=["'][^"']*company[^"']*["'][^>]*>([^<]+)</span>""",
    r"(?i)<h1[^>]*>([^<]{3,100})</h1>",
    r"(?i)<h2[^>]*>([^<]{3,100})</h2>",
]
NO_COMPANY = [r"(?i)^(10-[KQ]|8-K|FORM|SEC|FILING|EDGAR)", r"^\d{4}-\d{2}-\d{2}"]
COMPANY_HEADERS = [r"(?i)COMPANY\s+CONFORMED\s+NAME[:\s]+([^\n\r]+)", r"(?i)(?:FILER|COMPANY)[:\s]+([A-Z][A-Z\s&\.,\-]{2,80})"]
CIK_LABELS = [
    r"(?i)CIK[:\s]+(\d{10})",
    r"(?i)CENTRAL\s+INDEX\s+KEY[:\s]+(\d{10})",
    r"(?i)C\.I\.K\.\s*[:\s]*(\d{10})",
    r"""(?i)<meta[^>]*name=["']cik["'][^>]*content=["'](\d{10})["']""",
    r"""(?i)<meta[^>]*content=["'](\d{10})["'][^>]*name=["']cik["']""",
    r"""(?i)<meta[^>]*property=["']cik["'][^>]*content=["'](\d{10})["']""",
]
CIK_CONTEXT = r"(?i)cik|central.*index"
LAW_TITLES = [(r"(?is)<title[^>]*>\s*(.*?)\s*</title>", 1), (r"(?is)<h1[^>]*>\s*(.*?)\s*</h1>", 1), (r"""(?is)<meta[^>]*name=["']title["'][^>]*content=["']([^"']*)["']""", 1)]
SUMMARY_WORDS = ["summary", "abstract", "overview"]
