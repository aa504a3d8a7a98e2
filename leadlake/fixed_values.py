"""Fixed values that results depend on: word lists, lookup tables, weights and patterns.

Everything here is data. Order matters wherever a rule says "first match wins".
"""

# --- fixed values: search text -------------------------------------------------------------
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "up", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "among", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does",
    "did", "will", "would", "could", "should", "may", "might", "must", "can",
]

IMPLICIT_INDUSTRIES = [
    ("Tecnologia", ["tech", "technology", "software", "it"]),
    ("E-commerce", ["ecommerce", "e-commerce", "retail", "commerce"]),
    ("Financeiro", ["finance", "financial", "bank", "banking"]),
    ("Saúde", ["health", "healthcare", "medical"]),
    ("Educação", ["education", "educational", "school"]),
    ("Industrial", ["manufacturing", "industrial"]),
]

IMPLICIT_LOCATIONS = [
    ("São Paulo", ["são paulo", "sp", "sao paulo"]),
    ("Rio de Janeiro", ["rio de janeiro", "rj", "rio"]),
    ("Belo Horizonte", ["belo horizonte", "bh", "minas"]),
    ("Brasília", ["brasília", "brasilia", "df"]),
    ("Salvador", ["salvador", "bahia", "ba"]),
]

IMPLICIT_SIZES = [
    ("1-10", ["startup", "small", "pequena"]),
    ("11-50", ["medium", "média", "mid-size"]),
    ("51-200", ["large", "grande", "big"]),
    ("200+", ["enterprise", "corporation", "multinational"]),
]

QUERY_EXPANSIONS = [
    ("tech", ["tecnologia", "software", "desenvolvimento", "startup"]),
    ("rest", ["restaurante", "comida", "delivery", "alimentação"]),
    ("saúde", ["clínica", "hospital", "médico", "dentista"]),
    ("adv", ["advogado", "escritório jurídico", "advocacia"]),
    ("cont", ["contador", "contabilidade", "escritório contábil"]),
]
EXPANSION_CITIES = ["são paulo", "rio", "belo horizonte"]
EXPANSION_AREAS = ["centro", "zona sul"]

FREQUENCY_STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was",
    "one", "our", "out", "day", "get", "has", "him", "his", "how", "man", "new", "now",
    "old", "see", "two", "way", "who", "boy", "did", "its", "let", "put", "say", "she",
    "too", "use", "com", "www", "http", "https", "html", "php", "asp", "jsp", "empresa",
    "company", "business", "service", "services", "solutions",
]

BROAD_QUERY_EXAMPLE = "São Paulo tecnologia"
IMPORT_ERROR = "Erro ao importar "

# --- fixed values: ranking -----------------------------------------------------------------
COMPONENT_WEIGHTS = {
    "text_relevance": 0.4,
    "industry_match": 0.25,
    "location_proximity": 0.15,
    "company_size": 0.1,
    "data_quality": 0.05,
    "freshness": 0.05,
}
PREFERENCE_WEIGHTS = {
    "industry_match": 0.25,
    "location_proximity": 0.15,
    "company_size": 0.1,
    "text_relevance": 0.4,
    "data_quality": 0.1,
}
TEXT_FIELD_WEIGHTS = [("company", 0.4), ("description", 0.3), ("industry", 0.2), ("contact", 0.1)]
QUALITY_FIELDS = ["company", "contact", "email", "phone", "industry", "location", "description"]
HIGHLIGHT_FIELDS = ["company", "description", "industry"]

# --- fixed values: contact data ------------------------------------------------------------
EMAIL_SKIP_WORDS = ["noreply", "no-reply", "example", "test"]
EMAIL_SKIP_WORDS_STRICT = ["noreply", "no-reply", "example", "test", "admin", "info@example"]
PERSONAL_EMAIL_DOMAINS = [
    "gmail.com", "yahoo.com", "hotmail.com", "outlook.com",
    "uol.com.br", "terra.com.br", "bol.com.br", "ig.com.br",
]
VALIDATOR_PERSONAL_DOMAINS = PERSONAL_EMAIL_DOMAINS + ["globo.com", "r7.com"]
SYSTEM_MAILBOX_WORDS = ["noreply", "no-reply", "test", "admin"]

LEGAL_SUFFIXES = ["ltda", "ltd", "inc", "corp", "sa", "me", "eireli", "epp"]
LEGAL_SUFFIXES_LONG = LEGAL_SUFFIXES + ["llc"]
BUSINESS_SUFFIXES = [
    "ltda", "ltd", "inc", "corp", "sa", "s.a.", "me", "mei",
    "eireli", "epp", "llc", "sociedade", "empresa", "companhia",
]
PLACEHOLDER_COMPANIES = ["test", "example", "sample", "demo"]

SOCIAL_DOMAINS = [
    "google.com", "facebook.com", "linkedin.com", "twitter.com",
    "instagram.com", "youtube.com", "wikipedia.org",
]
NON_COMPANY_DOMAINS = SOCIAL_DOMAINS + [
    "amazon.com", "mercadolivre.com.br", "olx.com.br", "reclameaqui.com.br",
]
LISTING_DOMAINS = NON_COMPANY_DOMAINS + ["guiamais.com.br", "paginas-amarelas.com"]
COMPANY_SITE_ENDINGS = [".com", ".com.br", ".org", ".net", ".br", ".co"]
BUSINESS_TLDS = [
    ".com.br", ".org.br", ".net.br", ".gov.br", ".edu.br",
    ".com", ".org", ".net", ".biz", ".info",
]

STATES = [
    "AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO",
    "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI",
    "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO",
]
MAJOR_CITIES = [
    "São Paulo", "Rio de Janeiro", "Belo Horizonte", "Brasília",
    "Salvador", "Fortaleza", "Curitiba", "Recife", "Porto Alegre",
]
CITIES = MAJOR_CITIES + ["Manaus", "Belém", "Goiânia", "Guarulhos", "Campinas"]

MOBILE_AREA_CODES = ["11", "21", "31", "41", "51"]
AREA_CODES = [
    "11", "12", "13", "14", "15", "16", "17", "18", "19",
    "21", "22", "24", "27", "28",
    "31", "32", "33", "34", "35", "37", "38",
    "41", "42", "43", "44", "45", "46", "47", "48", "49",
    "51", "53", "54", "55",
    "61", "62", "63", "64", "65", "66", "67", "68", "69",
    "71", "73", "74", "75", "77", "79",
    "81", "82", "83", "84", "85", "86", "87", "88", "89",
    "91", "92", "93", "94", "95", "96", "97", "98", "99",
]

COMPLETENESS_WEIGHTS = [
    ("company", 0.3), ("email", 0.2), ("phone", 0.15), ("website", 0.1),
    ("industry", 0.1), ("location", 0.05), ("description", 0.05),
]

# --- fixed values: pages -------------------------------------------------------------------
CONTACT_PAGE_WORDS = [
    "contato", "contact", "sobre", "about", "empresa",
    "quem somos", "who we are", "fale conosco",
]
PAGE_INDUSTRIES = [
    ("Tecnologia", ["software", "tech", "desenvolvimento", "sistemas", "ti"]),
    ("Consultoria", ["consultoria", "consulting", "advisory"]),
    ("Marketing", ["marketing", "publicidade", "advertising"]),
    ("Saúde", ["saúde", "health", "medical", "medicina"]),
    ("Educação", ["educação", "education", "ensino", "escola"]),
    ("Financeiro", ["financeiro", "finance", "banco", "investimento"]),
]
ABOUT_CLASSES = ["about", "company-description", "intro", "overview", "description"]
HEADCOUNT_WORDS = ["employees", "people", "staff"]

# --- fixed values: reports -----------------------------------------------------------------
MONTH_NAMES = ["Jan", "Fev", "Mar", "Abr", "Mai", "Jun", "Jul", "Ago", "Set", "Out", "Nov", "Dez"]
LEAD_STATUS_NEW = "Novo"
PRIORITY_HIGH = "Alta"
PRIORITY_MEDIUM = "Média"
DEFAULT_IMPORT_SCORE = 75
CONTACT_INTERACTIONS = ["contact", "email", "call"]
ROI_HIGH, ROI_MEDIUM, ROI_LOW = 500, 200, 50
