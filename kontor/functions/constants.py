"""Fixed values that must equal the ledger application's for equal results.

FIXED VALUES -- kept as plain text, in their natural order."""

# ISO-2 country code -> display name (dashboard and country table)
COUNTRY_NAMES = {
    "DE": "Germany",
    "AT": "Austria",
    "FR": "France",
    "CH": "Switzerland",
    "IT": "Italy",
    "ES": "Spain",
    "NL": "Netherlands",
    "BE": "Belgium",
    "PL": "Poland",
    "LU": "Luxembourg",
    "Unknown": "Unknown",
}

# document type code -> name (defined by the application, optional column here)
DOCUMENT_TYPE_NAMES = {
    "RE": "Invoice (Rechnung)",
    "GU": "Credit Note (Gutschrift)",
    "V": "Sale (Verkauf)",
}

# customers by number of orders: 1 / up to 3 / up to 10 / more
CUSTOMER_CATEGORIES = ["One-time", "Occasional (2-3)", "Regular (4-10)", "Loyal (10+)"]

# profit-margin bins, right-closed: (-inf,0] (0,10] (10,20] (20,30] (30,40] (40,50] (50,inf)
MARGIN_EDGES = [0, 10, 20, 30, 40, 50]
MARGIN_LABELS = ["Negative", "0-10%", "10-20%", "20-30%", "30-40%", "40-50%", "50%+"]

# order-value bin edges, chosen by the largest positive order value
VALUE_EDGES_UPTO_100 = [0, 10, 20, 30, 50, 75, 100]
VALUE_EDGES_UPTO_500 = [0, 25, 50, 100, 150, 200, 300, 500]
VALUE_EDGES_ABOVE_500 = [0, 50, 100, 200, 300, 500, 750, 1000]  # + [max + 1]
CURRENCY_SIGN = "€"

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# placeholders for an unknown platform / country
UNKNOWN = "Unknown"

# platform names used by the source filter flags
AMAZON = "Amazon"
EBAY = "Ebay"

# date format of the source filters (DD.MM.YYYY)
FILTER_DATE_PATTERN = r"^\d{2}\.\d{2}\.\d{4}$"
DATE_EMPTY = "Date empty"
DATE_BAD_FORMAT = "Use DD.MM.YYYY format"
DATE_INVALID = "Invalid date"

# --- marketplace export ----------------------------------------------------
HEADER_MARKER = "Datum der Transaktionserstellung"
HEADER_SEARCH_ROWS = 19      # rows 1..19
HEADER_SEARCH_COLS = 9       # columns 1..9
FIXED_HEADER_ROW = 11        # the matcher's fixed layout
SELLER_MARKER = "Verkäufer"
AMOUNT_MARKER = "Betrag"
OTHER_FEE_MARKER = "Andere Geb"
EMPTY_AMOUNTS = ["--", "—"]

# export header name -> normalized field; the first six fall back to columns 1..6
EXPORT_FIELDS = [
    ("Datum der Transaktionserstellung", "datum", 1),
    ("Typ", "typ", 2),
    ("Bestellnummer", "bestellnummer", 3),
    ("Alte Bestellnummer", "alte_bestellnummer", 4),
    ("Nutzername des Käufers", "nutzername", 5),
    ("Name des Käufers", "name", 6),
    ("Transaktionsbetrag (inkl. Kosten)", "transaktionsbetrag", None),
    ("Zwischensumme Artikel", "zwischensumme", None),
    ("Verpackung und Versand", "verpackung", None),
    ("Fixer Anteil der Verkaufsprovision", "fixer_anteil", None),
    ("Variabler Anteil der Verkaufsprovision", "variabler_anteil", None),
    ("Gebühr für sehr hohe Quote an „nicht wie beschriebenen Artikeln\"", "gebuehr_hohe_quote", None),
    ("Gebühr für unterdurchschnittlichen Servicestatus", "gebuehr_servicestatus", None),
    ("Internationale Gebühr", "internationale_gebuehr", None),
    ("Betrag abzügl. Kosten", "betrag_abzgl", None),
    ("Auszahlung Nr.", "auszahlungsnr", None),
    ("Auszahlungsdatum", "auszahlungsdatum", None),
]
AMOUNT_FIELDS = [
    "transaktionsbetrag", "zwischensumme", "verpackung", "fixer_anteil",
    "variabler_anteil", "gebuehr_hohe_quote", "gebuehr_servicestatus",
    "internationale_gebuehr", "betrag_abzgl",
]

# report layout: columns A..R with their header texts, then T (copy of J) and U (J - T)
REPORT_HEADERS = [
    ("A", "Datum der Transaktionserstellung"),
    ("B", "Typ"),
    ("C", "Bestellnummer"),
    ("D", "Alte Bestellnummer"),
    ("E", "Nutzername des Käufers"),
    ("F", "Name des Käufers"),
    ("G", "KD-NR"),
    ("H", "RG-NR"),
    ("I", "Transaktionsbetrag (inkl. Kosten)"),
    ("J", "Zwischensumme Artikel"),
    ("K", "Fixer Anteil der Verkaufsprovision"),
    ("L", "Variabler Anteil der Verkaufsprovision"),
    ("M", "Gebühr für sehr hohe Quote an „nicht wie beschriebenen Artikeln\""),
    ("N", "Gebühr für unterdurchschnittlichen Servicestatus"),
    ("O", "Internationale Gebühr"),
    ("P", "Betrag abzügl. Kosten"),
    ("Q", "Auszahlung Nr."),
    ("R", "Auszahlungsdatum"),
]
REPORT_FIRST_DATA_ROW = 5
FEE_ACCOUNT = "7400700"
FEE_LINE_LABEL = "Gebuehr"
OTHER_FEE_LINE_LABEL = "Andere Gebuehr"
HEADER_LABELS = ["Verkäufer", "Transaktionen", "Betrag"]
PREVIEW_ROWS = 50
TOP_CUSTOMERS = 20
TOP_ORDERS = 20
TOP_COUNTRIES = 10
