"""Names of citation templates and the classes derived from them."""

# Template types (lower case) that count as citations.
CITATION_TYPES = [
    "citation", "cite arxiv", "cite av media", "cite av media notes", "cite book", "cite conference",
    "cite dvd notes", "cite encyclopedia", "cite episode", "cite interview", "cite journal",
    "cite mailing list", "cite map", "cite news", "cite newsgroup", "cite podcast", "cite press release",
    "cite report", "cite serial", "cite sign", "cite speech", "cite techreport", "cite thesis", "cite web",
]

# Template names the normaliser accepts, per language (first letter is case-insensitive).
TEMPLATE_NAMES = {
    "en": [
        "Citation", "Cite AV media", "Cite AV media notes", "Cite book", "Cite conference", "Cite DVD notes",
        "Cite encyclopedia", "Cite episode", "Cite interview", "Cite journal", "Cite mailing list", "Cite map",
        "Cite news", "Cite newsgroup", "Cite podcast", "Cite press release", "Cite report", "Cite serial",
        "Cite sign", "Cite speech", "Cite techreport", "Cite thesis", "Cite web", "Cite arXiv",
        "London Gazette", "Harvnb", "Harvard citation no brackets", "NRISref", "Cite gnis", "GNIS", "GEOnet3",
        "Timatic Visa Policy", "Soccerbase season", "Cite sports-reference", "NHLE",
        "National Heritage List for England",
    ],
    "it": ["Cita pubblicazione"],
}

# Class words that are lower-cased.
LOWERED_CLASSES = ["Gazette", "Harvnb", "NRISref", "GNIS", "GEOnet3", "Policy", "NHLE", "England"]

# Lower-case template type -> class name used by the field rules, where it is not the last word.
CANONICAL_CLASSES = {
    "cite av media": "audio-visual",
    "cite av media notes": "AV-media-notes",
    "cite dvd notes": "DVD-notes",
    "cite encyclopedia": "encyclopaedia",
    "cite mailing list": "mailinglist",
    "cite press release": "pressrelease",
}

# Classes that take a field, or that do not.
CLASSES_WITH_VOLUME = [
    "citation", "audio-visual", "book", "conference", "encyclopaedia", "interview", "journal", "magazine", "map",
    "news", "report", "techreport",
]
CLASSES_WITH_ISSUE = [
    "citation", "conference", "episode", "interview", "journal", "magazine", "map", "news", "gazette",
]
CLASSES_WITHOUT_PAGES = ["audio-visual", "episode", "mailinglist", "newsgroup", "podcast", "serial", "sign", "speech"]
CLASSES_WITH_ACCESS_DATE = ["nrisref", "gnis", "policy", "season", "sports-reference", "nhle", "england"]
CLASSES_WITH_SERIES_NUMBER = ["nrisref", "gnis", "geonet3", "season", "nhle", "england"]

# Default title type per class.
TITLE_TYPES = {
    "AV-media-notes": "Media notes",
    "DVD-notes": "Media notes",
    "mailinglist": "Mailing list",
    "map": "Map",
    "podcast": "Podcast",
    "pressrelease": "Press release",
    "report": "Report",
    "techreport": "Technical report",
    "thesis": "Thesis",
}

# Cities of the gazette.
GAZETTE_CITIES = {"b": "Belfast", "belfast": "Belfast", "e": "Edinburgh", "edinburgh": "Edinburgh"}
GAZETTE_DEFAULT_CITY = "London"

# Fixed value: title given to a citation that could not be read.
NOT_PARSABLE = "Citation generic template not possible"
