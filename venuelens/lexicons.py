"""Word lists, labels and codes that decide results."""

from __future__ import annotations

# Category names of menus and items.
STARTER, MAIN, DESSERT, DRINK, SET_MENU, OTHER = (
    "entrée", "plat", "dessert", "boisson", "formule", "autre",
)
CATEGORIES = [STARTER, MAIN, DESSERT, DRINK, SET_MENU, OTHER]
COURSE_CATEGORIES = [STARTER, MAIN, DESSERT]
# The selection widget names the starter category without its accent.
CATEGORY_ALIASES = {"entree": STARTER}

# Words that classify a whole menu by its title, in order of priority.
MENU_TITLE_TERMS = [
    (DRINK, [
        "boisson", "cocktail", "bière", "bier", "vin", "apéritif", "aperitif", "digestif",
        "café", "cafe", "thé", "the", "chocolat chaud", "drink", "soda", "jus", "alcool",
        "champagne", "spiritueux",
    ]),
    (DESSERT, [
        "dessert", "fromage", "fromages", "dolci", "sucré", "sucree", "pâtisserie",
        "patisserie", "glace", "glaces", "sorbet",
    ]),
    (STARTER, [
        "entrée", "entree", "starter", "hors d'oeuvre", "hors d'œuvre", "amuse",
        "antipasti", "antipasto",
    ]),
    (MAIN, [
        "plat", "plats", "main course", "viande", "poisson", "pâtes", "pasta", "burger",
        "pizza", "risotto", "grillade", "rôtisserie", "rotisserie", "spécialité",
        "specialite", "suggestion",
    ]),
    (SET_MENU, ["menu", "formule", "dégustation", "déjeuner", "dîner"]),
]

# Words that classify one item by its title and description, in order of priority.
ITEM_TERMS = [
    (DRINK, [
        "café", "cafe", "thé", "the", "chocolat", "infusion", "cappuccino", "espresso",
        "latte", "macchiato", "coca", "pepsi", "orangina", "schweppes", "evian", "badoit",
        "san pellegrino", "perrier", "vittel", "eau", "minérale", "minerale", "bouteille",
        "demi", "bière", "biere", "pression", "heineken", "kronenbourg", "guinness", "ipa",
        "stella", "cidre", "panaché", "panache", "kir", "pastis", "ricard", "whisky",
        "vodka", "gin", "rhum", "tequila", "get", "amer", "martini", "campari", "mojito",
        "margarita", "daïquiri", "spritz", "bellini", "sangria", "irish", "cosmopolitan",
        "negroni", "manhattan", "bloody mary", "pina colada", "mai tai", "long island",
        "cocktail", "apéritif", "aperitif", "digestif", "alcool", "limonade", "sirop",
        "diabolo", "jus d'orange", "jus de", "smoothie", "milkshake", "lait",
        "chocolat chaud",
    ]),
    (DESSERT, [
        "dessert", "glace", "sorbet", "gâteau", "gateau", "tarte", "mousse", "baba",
        "crème brûlée", "creme brulee", "millefeuille", "mille-feuille", "macaron",
        "profiterole", "tiramisu", "fondant", "chocolat", "soufflé", "souffle",
        "île flottante", "ile flottante", "cheesecake", "panna cotta", "éclair", "eclair",
        "madeleine", "financier", "cannelé", "cannele", "clafoutis", "compote", "beignet",
        "crêpe suzette", "paris-brest", "tatin", "crumble", "sablé", "sable", "cookie",
        "brownie", "pain perdu", "brioche", "viennoiserie", "croissant",
        "salade de fruit", "fruits rouges",
    ]),
    (STARTER, [
        "entrée", "entree", "salade", "soupe", "velouté", "veloute", "bisque", "tartare",
        "carpaccio", "ceviche", "foie gras", "terrine", "rillettes", "œuf", "oeuf",
        "burrata", "mozzarella", "bruschetta", "crostini", "gaspacho", "gravlax",
        "saumon fumé", "saumon fume", "huître", "huitre", "escargot", "gambas", "crevette",
    ]),
    (MAIN, [
        "entrecôte", "entrecote", "pavé", "pave", "filet", "magret", "confit", "rôti",
        "roti", "grillé", "grille", "poêlé", "poele", "braisé", "braise", "mijoté",
        "mijote", "burger", "pizza", "pâtes", "pates", "risotto", "brochette", "côte",
        "cote", "gigot", "andouillette", "boudin", "cabillaud", "bar", "lotte", "raie",
        "saint-jacques", "omelette", "galette", "crêpe", "crepe", "wok", "curry",
        "tournedos", "faux-filet", "bavette", "jarret",
    ]),
]

# Seasonal products.
SEASON_TERMS = {
    "printemps": [
        "asperge", "petit pois", "fève", "feve", "artichaut", "épinard", "epinard",
        "radis", "fraise", "rhubarbe", "morille", "aillet", "agneau", "pascal", "navet",
        "primeur",
    ],
    "été": [
        "tomate", "courgette", "aubergine", "poivron", "melon", "pastèque", "pasteque",
        "pêche", "peche", "abricot", "brugnon", "nectarine", "figue", "framboise",
        "myrtille", "groseille", "cassis", "mûre", "mure", "salade", "concombre",
        "haricot", "vert", "maïs", "mais", "basilic", "menthe", "coriandre",
    ],
    "automne": [
        "champignon", "cèpe", "cepe", "girolle", "trompette", "morille", "potiron",
        "potimarron", "courge", "butternut", "marrons", "châtaigne", "chataigne",
        "raisin", "coing", "poire", "pomme", "noix", "noisette", "gibier", "sanglier",
        "chevreuil", "faisan",
    ],
    "hiver": [
        "truffe", "endive", "chou", "poireau", "céleri", "celeri", "panais", "rutabaga",
        "topinambour", "betterave", "mâche", "mache", "agrume", "orange", "clémentine",
        "clemenetine", "mandarine", "pamplemousse", "citron", "kaki", "litchi",
        "raclette", "fondue", "tartiflette",
    ],
}

# Languages the primary sentiment model covers.
SUPPORTED_LANGUAGES = ["fr", "en", "it", "es", "pt", "de", "nl"]

# Stop words of the word-frequency report.
STOP_WORDS = [
    "le", "la", "les", "un", "une", "des", "de", "du", "et", "à", "a", "au", "aux", "en",
    "est", "ce", "que", "qui", "pour", "pas", "ne", "nous", "vous", "ils", "elles", "il",
    "elle", "on", "se", "sa", "son", "ses", "mais", "ou", "y", "leur", "leurs", "dans",
    "par", "sur", "avec", "plus", "très", "tres", "tout", "tous", "toute", "toutes",
    "cette", "ces", "etait", "était", "ont", "ete", "été", "j'ai", "ca", "ça", "c'est",
    "comme", "aussi", "bien", "fait", "faire", "même", "meme", "deja", "déjà", "the",
    "and", "of", "to", "is", "in", "for", "we", "this", "with", "was", "very", "but",
    "had", "have", "they", "our", "are", "us", "it", "be", "i", "you", "as", "if", "from",
]

# Month labels.
MONTH_NAMES = [
    "Jan", "Fév", "Mar", "Avr", "Mai", "Juin", "Juil", "Août", "Sep", "Oct", "Nov", "Déc",
]

# Upper bounds and labels of the quality classes.
QUALITY_BINS = [
    (3.5, "Faible (<3.5)"), (4.0, "Moyen (3.5-4)"), (4.5, "Bon (4-4.5)"),
    (5.0, "Excellent (>4.5)"),
]

# Columns of the venue export.
EXPORT_COLUMNS = [
    "locationId", "name", "rating", "reviewCount", "priceLevel", "arrondissement",
    "cuisines", "nb_items_total", "shannon_entropy", "hasMichelin", "latitude",
    "longitude",
]

# Display texts of test results, by test: its name and the name of its effect size.
TEST_TEXTS = {
    "chi2": ("Khi² d'independance", "Cramer's V"),
    "anova": ("ANOVA a un facteur", "Eta-carre"),
    "kruskal": ("Kruskal-Wallis", "Epsilon-carre"),
    "spearman": ("Correlation de Spearman", "|rho|"),
    "welch": ("Welch t-test", "Cohen's d"),
}

# Parts of the display sentence of a test, and the sentence where it could not be run.
SUMMARY_PARTS = ["**", "** : ", " — ", "  \nTaille d'effet (", ") = ", " (", ")  \nN = "]
SUMMARY_MISSING = "*Test indisponible : "

# The district label and that of an unknown district.
DISTRICT_PREFIX = "Arr "
DISTRICT_UNKNOWN = "Inconnu"

# Own definition: terms of the small sentiment scorer used where no model is plugged in.
POSITIVE_TERMS = ["good", "great", "excellent", "delicious", "bon", "bien", "gut", "lecker", "buen", "bueno"]
NEGATIVE_TERMS = ["bad", "worthless", "pathetic", "trash", "idiot", "moron", "mauvais", "mal", "schlecht", "malo", "horrible"]

# Sentences of the narrative.
SUMMARY_TEXT = "%d restaurants analyses dans %d arrondissements — note moyenne %.2f/5, mediane %.2f/5"
CONTRAST_TEXT = "Arr %d : note moyenne %.2f"
SIGNIFICANT_TEXT = " (significatif)"
ANTICORRELATION_TEXT = "%s diminue quand %s augmente"
BEST_VALUE_TEXT = "**Meilleur rapport qualite/prix** : "

# Menu categories that a selection offers.
FILTER_CATEGORIES = ["entree", "plat", "dessert", "boisson"]
