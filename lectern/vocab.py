"""Word lists and periods. Larger vocabularies (frames, compound phrases) are read from files, by load_terms()."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Keywords:
    """Keywords of an era: whole words, pairs of words, prefixes by length, and seven-letter prefixes that block prefixes up to seven letters."""

    unigrams: frozenset[str] = frozenset()
    bigrams: frozenset[str] = frozenset()
    prefixes: dict[int, tuple[str, ...]] = field(default_factory=dict)
    exclude: tuple[str, ...] = ()


# Keyword dictionaries of three eras.
EARLY = Keywords(
    bigrams=frozenset((
        "foreign work", "foreign worker", "foreign workers", "foreign labor", "foreign laborer", "foreign laborers",
    )),
    prefixes={
        4: ("jews", "jewi", "race", "born"),
        5: (
            "immig", "inmig", "imnig", "imigr", "iumig", "immlg", "emigr", "migra", "alien", "chine", "irish", "iwish", "irise", "ivish", "itish",
            "inish", "cooly", "dutch", "norwe", "finni", "swedi", "welsh", "quota", "idiot", "zioni", "racis", "slavs", "anglo", "saxon", "birth",
            "asiat", "asian",
        ),
        6: (
            "immnig", "imnmig", "inmmig", "immlig", "imlmig", "ilmmig", "imimig", "imumig", "imamig", "chiine", "chiese", "chinse", "clines",
            "ciiese", "chinam", "coolie", "celest", "mongol", "japane", "apanes", "german", "gernan", "polish", "danish", "celtic", "ethnic",
            "slavic", "teuton", "hebrew", "scandi", "sicili", "neapol", "slovak", "bohemi",
        ),
        7: (
            "scottis", "gernman", "germnan", "germlan", "italian", "newcome", "arrival", "belgian", "russian", "undesir", "epilept", "lunatic",
            "assimil", "melting", "europea", "europei", "etropea", "earopea", "enropea", "uropean", "tongues", "hungari", "orienta",
        ),
        8: ("foreigne",),
        9: ("naturaliz", "englishne", "unassimil", "citizensh", "citizensb"),
        10: ("nativeborn", "hyphenated", "americaniz"),
        11: ("unnaturaliz", "foreignborn", "foreign-bor", "native-born"),
    },
    exclude=("germany", "alienat", "germane", "gernane", "polishe", "quotati", "idiotic"),
)
MID = Keywords(
    bigrams=frozenset((
        "foreign work", "foreign worker", "foreign workers", "foreign labor", "foreign laborer", "foreign laborers", "foreign born", "native born",
        "ellis island", "guest worker", "guest workers", "seasonal work", "seasonal worker", "seasonal workers", "permanent resident",
        "permanent residents", "permanent residency", "work permit", "work permits", "day labor", "day laborer", "day laborers", "low skilled",
        "high skilled",
    )),
    prefixes={
        4: ("jewi", "visa", "asyl"),
        5: (
            "immig", "emigr", "migra", "alien", "chine", "irish", "quota", "cuban", "inmig", "passp", "asiat", "asian", "undoc", "i.n.s",
        ),
        6: ("chinam", "ethnic", "border", "deport"),
        7: (
            "newcome", "undesir", "orienta", "customs", "refugee", "mexican", "bracero", "origins", "wetback", "illegal", "unlawfu", "smuggle",
        ),
        8: (
            "nonrefug", "foreigne", "arrivals", "nonimmig", "detainee", "nonquota", "subquota", "resettle", "filipino",
        ),
        9: ("naturaliz", "unassimil", "nonreside", "nationali", "detention", "nationals", "citizensh"),
        10: ("nativeborn", "americaniz", "farmworker", "declarants"),
        11: (
            "unnaturaliz", "foreignborn", "foreign-bor", "native-born", "nationalori", "commemorati", "americanbor",
        ),
    },
    exclude=("alienat", "quotati", "borderl"),
)
MODERN = Keywords(
    unigrams=frozenset({"ins"}),
    bigrams=frozenset((
        "foreign born", "native born", "ellis island", "foreign worker", "foreign workers", "foreign labor", "foreign laborers", "guest worker",
        "guest workers", "permanent resident", "permanent residents", "permanent residency", "work permit", "work permits", "day labor",
        "day laborer", "day laborers", "seasonal worker", "seasonal workers", "low skilled", "high skilled", "dream act",
    )),
    prefixes={
        2: ("j1", "jl"),
        3: ("h1b", "hlb", "i94", "h2b", "dhs"),
        4: ("visa", "asyl", "daca"),
        5: (
            "undoc", "migra", "alien", "quota", "cuban", "irish", "emigr", "i.n.s", "d.h.s", "imnig", "inmig", "immlg", "carib", "uscis", "asian",
        ),
        6: ("border", "deport", "hispan", "amnest", "coolie", "mongol"),
        7: ("customs", "everify", "haitian", "refugee", "refuges", "italian", "mexican", "bracero"),
        8: (
            "nonrefug", "foreigne", "newcomer", "arrivals", "dreamers", "jamaican", "multicul", "detainee", "nonquota", "subquota", "resettle",
            "honduran", "nonimmig", "illegals", "filipino",
        ),
        9: (
            "naturaliz", "citizensh", "citizensb", "nonreside", "detention", "illegally", "colombian", "nonhispan",
        ),
        10: (
            "nativeborn", "americaniz", "farmworker", "lowskilled", "salvadoran", "guatemalan", "nicaraguan", "dominicans",
        ),
        11: ("unnaturaliz", "foreignborn", "highskilled", "salvadorian"),
    },
    exclude=("alienat", "quotati", "borderl", "caribou"),
)

# First and last session of each model's era, and of the analysis periods.
ERAS = {"early": (43, 73), "mid": (70, 88), "modern": (85, 114), "new_source": (112, 116)}
INTERPOLATE = (73, 85)
SOURCE_CHANGE = 112

# Presidents as half-open year ranges.
PRESIDENTS = [
    (1869, 1877, "R", "Ulysses S. Grant"), (1877, 1881, "R", "Rutherford B. Hayes"), (1881, 1885, "R", "Chester A. Arthur"),
    (1885, 1889, "D", "Grover Cleveland (85-89)"), (1889, 1893, "R", "Benjamin Harrison"), (1893, 1897, "D", "Grover Cleveland (93-97)"),
    (1897, 1902, "R", "William McKinley"), (1902, 1909, "R", "Theodore Roosevelt"), (1909, 1913, "R", "William Howard Taft"),
    (1913, 1921, "D", "Woodrow Wilson"), (1921, 1924, "R", "Warren G. Harding"), (1924, 1929, "R", "Calvin Coolidge"),
    (1929, 1933, "R", "Herbert Hoover"), (1933, 1945, "D", "Franklin D. Roosevelt"), (1945, 1953, "D", "Harry S. Truman"),
    (1953, 1961, "R", "Dwight D. Eisenhower"), (1961, 1964, "D", "John F. Kennedy"), (1964, 1969, "D", "Lyndon B. Johnson"),
    (1969, 1975, "R", "Richard Nixon"), (1975, 1977, "R", "Gerald R. Ford"), (1977, 1981, "D", "Jimmy Carter"),
    (1981, 1989, "R", "Ronald Reagan"), (1989, 1993, "R", "George Bush"), (1993, 2001, "D", "William J. Clinton"),
    (2001, 2009, "R", "George W. Bush"), (2009, 2017, "D", "Barack Obama"), (2017, 2021, "R", "Donald J. Trump"),
]
# The days on which the president's party may change, each with the party before it; none before the first.
WHITE_HOUSE = [
    ("1869-03-04", None), ("1885-03-04", "R"), ("1889-03-04", "D"), ("1893-03-04", "R"), ("1897-03-04", "D"), ("1913-03-04", "R"),
    ("1921-03-04", "D"), ("1933-03-04", "R"), ("1953-01-20", "D"), ("1961-01-20", "R"), ("1969-01-20", "D"), ("1977-01-20", "R"),
    ("1981-01-20", "D"), ("1993-01-20", "R"), ("2001-01-20", "D"), ("2009-01-20", "R"), ("2017-01-20", "D"),
]
# Named periods, each up to its year.
NAMED_PERIODS = [
    (1882, "1873-1881"), (1891, "1882-1890"), (1903, "1891-1902"), (1913, "1903-1912"), (1920, "1913-1919"),
    (1925, "1920-1924"), (1932, "1925-1931"), (1965, "1932-1965"),
]
LAST_PERIOD = "1965+"

# States by region.
NORTHEAST_MIDWEST = (
    "ME", "MA", "RI", "CT", "NH", "VT", "NY", "PA", "NJ", "DE", "OH", "IN", "MI", "IL", "MO", "WI", "MN", "IA", "KS", "NE", "SD", "ND", "DK",
)
SOUTH = ("WV", "VI", "VA", "KY", "TN", "NC", "SC", "GA", "AL", "MS", "AR", "LA", "FL", "TX", "OK", "NM", "AZ")
WEST = ("CO", "WY", "MT", "ID", "WA", "OR", "UT", "NV", "CA", "AK", "HI")

# Misread forms of "The", longer ones first.
MISREAD_THE = (
    "Tile", "Tlie", "Time", "Tihe", "Tire", "Thie", "Tite", "Tlhe", "Tise", "Tlfe", "Tlle", "Tfhe", "Tiie", "Thle", "Tlte",
) + ("Tle", "Tme", "Tne", "Tie", "Tue", "Tte", "Tse")

# Metaphor words by domain.
METAPHORS = {
    "water": [
        "flood", "floods", "flooding", "river", "rivers", "stream", "tide", "tides", "water", "waters", "ocean", "oceans", "wave", "waves",
    ],
    "animal": [
        "animal", "animals", "beast", "beasts", "sheep", "herd", "herds", "hog", "hogs", "pig", "pigs", "livestock", "dog", "dogs", "brute",
        "brutes", "horse", "horses", "cow", "cows", "cattle",
    ],
    "vermin": [
        "rat", "rats", "vermin", "worm", "worms", "bug", "bugs", "parasite", "parasites", "lice", "insect", "insects", "pest", "pests", "flea",
        "fleas", "leech", "leeches", "rodent", "rodents", "infestation", "infestations",
    ],
    "disease": ["disease", "diseases", "virus", "viruses", "infection", "infections", "illness", "illnesses"],
    "cargo": [
        "thing", "things", "object", "objects", "cargo", "cargoes", "goods", "tonnage", "merchandise", "item", "items", "commodities", "packages",
        "products", "baggage", "shipment", "shipments", "stuff", "material",
    ],
    "machines": ["machine", "machines", "machinery", "equipment", "hardware", "engine", "engines", "tool", "tools"],
}

# How a speaker's line begins in transcripts.
PRESIDENT_STARTS = ["the president", "president bush", "president trump", "president obama", "president clinton", "president reagan", "president carter"]
OTHER_STARTS = [
    "q", "moderator", "senior administration official", "the vice president", "the prime minister", "the premier", "the vice premier",
    "the chancellor", "the first lady", "audience", "crowd", "reporter", "the press", "child", "resident", "president mubarak",
    "president yeltsin", "president putin", "president karzai", "president mitterrand", "president macron", "president gorbachev",
]
TITLES = [
    "mr.", "mrs.", "ms.", "dr.", "sen.", "colonel", "admiral", "director", "secretary", "chairman", "general", "ambassador", "administrator",
    "premier", "chancellor", "governor",
]
PAIRED_TITLES = ["prime minister", "vice president", "vice premier", "attorney general", "major general"]

# Neighbouring lemmas that one source writes as one word; the key is the pair.
FUSED_LEMMAS = {
    "self (n) sufficiency (n)": "selfsufficiency (n)", "law (n) abide (v)": "lawabide (v)", "high (j) skilled (j)": "highskilled (j)",
    "family (n) based (n)": "familybased (j)", "family (n) sponsored (j)": "familysponsored (j)", "aids (n) infected (j)": "aidsinfected (j)",
    "employment (n) based (n)": "employmentbased (j)", "farm (n) worker (n)": "farmworker (n)", "farm (v) worker (n)": "farmworker (n)",
    "two (c) third (n)": "twothird (n)",
}

# Confusion matrices of the tone models, rows by true class, columns by predicted class (anti, neutral, pro).
CONFUSION = {
    ("early", "early", "na"): [[0.67296512, 0.25306848, 0.07396641], [0.25547352, 0.63874745, 0.10577902], [0.27254098, 0.2295082, 0.49795082]],
    ("early", "mid", "na"): [[0.72093023, 0.24418605, 0.03488372], [0.23076923, 0.67420814, 0.09502262], [0.28125, 0.3125, 0.40625]],
    ("modern", "mid", "D"): [[0.65979381, 0.24742268, 0.09278351], [0.21428571, 0.64285714, 0.14285714], [0.21153846, 0.25, 0.53846154]],
    ("modern", "mid", "R"): [[0.57142857, 0.375, 0.05357143], [0.25373134, 0.71641791, 0.02985075], [0.05263158, 0.34210526, 0.60526316]],
    ("modern", "mid", "na"): [[0.63953488, 0.28488372, 0.0755814], [0.20361991, 0.69683258, 0.09954751], [0.109375, 0.28125, 0.609375]],
    ("modern", "modern", "D"): [[0.6044686, 0.2807971, 0.1147343], [0.14846416, 0.59982935, 0.25170648], [0.06940407, 0.15515988, 0.77543605]],
    ("modern", "modern", "R"): [[0.72163121, 0.23167849, 0.04669031], [0.25114679, 0.55963303, 0.18922018], [0.0994152, 0.29385965, 0.60672515]],
    ("modern", "modern", "na"): [[0.67923851, 0.24335489, 0.07740661], [0.18128059, 0.5632137, 0.25550571], [0.06874096, 0.17510854, 0.75615051]],
}

# Terms that name immigrants by themselves, terms that do so after a group's name, the groups with their nouns, and phrases
# that are written as one word before any other.
MENTIONS = (
    "immigrants", "inmigrants", "imnigrants", "aliens", "emigrants", "migrants", "foreigner", "foreigners", "refugees", "asylees", "newcomer",
    "newcomers", "entrants", "arrivals", "coolies", "coolys", "emigres", "undesirables", "illegals", "exiles", "asylumseeker", "asylumseekers",
    "displacedperson", "displacedpersons", "displacedpeople", "displacedpeoples", "foreignborn",
)
AFTER_GROUP = (
    "immigrant", "inmigrant", "imnigrant", "immigrants", "inmigrants", "imnigrants", "alien", "aliens", "emigrant", "emigrants", "migrant",
    "migrants", "foreigner", "foreigners", "refugee", "refugees", "asylee", "asylees", "newcomer", "newcomers", "entrant", "entrants", "arrival",
    "arrivals", "coolie", "coolies", "cooly", "coolys", "emigre", "emigres", "undesirables", "illegals", "exile", "exiles", "asylumseeker",
    "asylumseekers", "displacedperson", "displacedpersons", "displacedpeople", "displacedpeoples", "horde", "hordes", "stranger", "strangers",
    "national", "nationals", "worker", "workers", "workman", "workmen", "workingman", "workingmen", "laborer", "laborers", "farmworker",
    "farmworkers", "prostitute", "prostitutes", "artisan", "artisans", "student", "students", "people", "person", "persons", "population",
    "populations", "citizen", "citizens", "settler", "settlers", "community", "communities", "voter", "voters", "resident", "residents", "man",
    "men", "male", "males", "woman", "women", "female", "females", "child", "children", "youth", "youths", "youngster", "youngsters", "teenager",
    "teenagers", "minor", "minors", "adult", "adults", "family", "families", "husband", "husbands", "wife", "wives", "bride", "brides", "couple",
    "couples", "parent", "parents", "mother", "mothers", "father", "fathers",
)
GROUPS = {
    "foreign": (), "foreignborn": (), "european": ("europeans",), "scandinavian": ("scandinavians",), "asian": ("asians", "asiatics"),
    "indochinese": (), "oriental": ("orientals",), "latinamerican": ("latinamericans",), "centralamerican": ("centralamericans",),
    "middleeastern": (), "arab": ("arabs",), "irish": ("irishman", "irishmen", "celts", "celtics"), "german": ("germans",),
    "prussian": ("prussians",), "mexican": ("mexicans",), "wetback": ("wetbacks",), "bracero": ("braceros",), "italian": ("italians",),
    "sicilian": ("sicilians",), "english": ("englishman", "englishmen"), "british": ("brits",), "canadian": ("canadians",), "russian": ("russians",),
    "polish": ("poles",), "chinese": ("chinaman", "chinamen"), "mongolian": ("mongolians",), "celestial": ("celestials",), "swedish": ("swedes",),
    "austrian": ("austrians",), "filipino": ("filipinos", "filipinas"), "cuban": ("cubans",), "hungarian": ("hungarians",),
    "norwegian": ("norwegians",), "czech": ("czechs",), "slovak": ("slvoaks",), "slovakian": ("slovakians",),
    "czechoslovakian": ("czechoslovakians",), "slavic": ("Slavs", "slavics"), "bohemian": ("bohemians",), "vietnamese": (),
    "scottish": ("scotsman", "scotsmen"), "salvadoran": ("salvadorans",), "salvadorian": ("salvadorians",), "korean": ("koreans",),
    "french": ("frenchman", "frenchmen"), "dominican": ("dominicans",), "guatemalan": ("guatemalans",), "greek": ("greeks",),
    "colombian": ("colombians",), "jamaican": ("jamaicans",), "yugoslavian": ("yugoslavians",), "serbian": ("serbians",), "serb": ("serbs",),
    "croatian": ("croatians",), "croat": ("croats",), "macedonian": ("macedonians",), "bosnian": ("bosnians",), "honduran": ("hondurans",),
    "japanese": ("japs",), "haitian": ("haitians",), "portuguese": (), "danish": ("danes",), "lithuanian": ("lithuanians",), "swiss": (),
    "welsh": ("welshman", "welshmen"), "taiwanese": (), "dutch": (), "brazilian": ("brazilians",), "finnish": ("finns",), "iranian": ("iranians",),
    "ecuadorian": ("ecuadorians",), "venezuelan": ("venezuelans",), "romanian": ("romanians",), "rumanian": ("rumanians",),
    "roumanian": ("roumanians",), "peruvian": ("peruvians",), "jewish": ("jews",), "catholic": ("catholics",), "mormon": ("mormons",),
    "muslim": ("muslims", "moslems"), "hindu": ("hindus", "hindoos"), "latino": ("latino", "latinos", "latina", "latinas"),
    "hispanic": ("hispanic", "hispanics"),
}
SPLIT_PHRASES = ("asylum seeker", "displaced person", "displaced people", "foreign born", "latin american", "central american", "middle eastern")
GENERIC = ("man", "woman", "men", "women")


# Nationality words by country, for countries with one per cent of the foreign-born in some census.
NATIONALITIES = {
    "Ireland": ("Irish", "Irishman", "Irishmen"), "Germany": ("German", "Germans"), "Mexico": ("Mexican", "Mexicans"),
    "Italy": ("Italian", "Italians"), "England": ("Englishman", "Englishmen"), "Canada": ("Canadian", "Canadians"),
    "Russia": ("Russian", "Russians"), "Poland": ("Polish", "Poles"), "China": ("Chinese", "Chinaman", "Chinamen"), "India": ("Indian", "Indians"),
    "Sweden": ("Swedish", "Swedes"), "Austria": ("Austrian", "Austrians"), "Philippines": ("Filipino", "Filipinos", "Filipina", "Filipinas"),
    "Cuba": ("Cuban", "Cubans"), "Hungary": ("Hungarian", "Hungarians"), "Norway": ("Norwegian", "Norwegians"),
    "Czechoslovakia": ("Czech", "Czechs", "Slovak", "Slovaks", "Slovakian", "Slovakians", "Czechoslovakian", "Czechoslovakians"),
    "Vietnam": ("Vietnamese",), "Scotland": ("Scottish", "Scots", "Scotsman", "Scotsmen"),
    "El Salvador": ("Salvadoran", "Salvadorans", "Salvadorian", "Salvadorians"), "Korea": ("Korean", "Koreans"),
    "France": ("Frenchman", "Frenchmen"), "Dominican Republic": ("Dominican", "Dominicans"), "Guatemala": ("Guatemalan", "Guatemalans"),
    "Greece": ("Greek", "Greeks"), "Colombia": ("Colombian", "Colombians"), "Jamaica": ("Jamaican", "Jamaicans"),
    "Yugoslavia": ("Yugoslavian", "Yugoslavians", "Serbian", "Serbians", "Serb", "Serbs", "Croatian", "Croatians", "Croat", "Croats", "Macedonian", "Macedonians", "Bosnian", "Bosnians"),
    "Honduras": ("Honduran", "Hondurans"), "Japan": ("Japanese", "Jap", "Japs"), "Haiti": ("Haitian", "Haitians"), "Portugal": ("Portuguese",),
    "Denmark": ("Danish", "Danes"), "Lithuania": ("Lithuanian", "Lithuanians"), "Switzerland": ("Swiss",),
    "Wales": ("Welsh", "Welshman", "Welshmen"), "Taiwan": ("Taiwanese",), "Netherlands": ("Dutch",), "Brazil": ("Brazilian", "Brazilians"),
    "Finland": ("Finnish", "Finn", "Finns"), "Iran": ("Iranian", "Iranians"), "Ecuador": ("Ecuadorian", "Ecuadorians"),
    "Venezuela": ("Venezuelan", "Venezuelans"), "Romania": ("Romanian", "Romanians", "Rumanian", "Rumanians", "Roumania", "Roumanian", "Roumanians"),
    "Peru": ("Peruvian", "Peruvians"),
}

# Terms and countries of four groups that are compared.
CHINESE_TERMS = (
    "china", "chinese", "chinamen", "chinaman", "indochina", "indochinese", "asia", "asian", "asians", "asiatic", "asiatics", "orient", "oriental",
    "orientals", "celestial", "celestials", "cooly", "coolie", "coolys", "coolies", "mongolian", "mongolians", "mongol", "mongols",
)
EUROPEAN_COUNTRIES = (
    "Ireland", "Germany", "Italy", "England", "Poland", "Sweden", "Austria", "Hungary", "Norway", "Czechoslovakia", "Scotland", "France", "Greece",
    "Yugoslavia", "Portugal", "Denmark", "Lithuania", "Switzerland", "Wales", "Netherlands", "Finland", "Romania",
)
MEXICAN_TERMS = (
    "mexico", "mexican", "mexicans", "wetback", "wetbacks", "bracero", "braceros", "mexicanamerican", "mexicanamericans",
)
HISPANIC_TERMS = (
    "mexico", "mexican", "mexicans", "wetback", "wetbacks", "bracero", "braceros", "mexicanamerican", "mexicanamericans", "hispanic", "hispanics",
    "latino", "latinos", "latina", "latinas", "hispanicamerican", "hispanicamericans", "cuba", "cuban", "cubanamerican", "cubanamericans", "cubans",
    "salvador", "salvadorans", "salvadorian", "salvadorians", "guatemala", "guatemalan", "guatemalans", "colombia", "colombian", "colombians",
    "honduras", "honduran", "hondurans", "ecuador", "ecuadorian", "ecuadorians", "venezuela", "venezuelan", "venezuelans", "peru", "peruvian",
    "peruvians",
)


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """(category, term) from a tab-separated file: frames, group names, compound phrases."""
    return spark.read.csv(path, sep="\t", schema="category string, term string").dropna().distinct()


def terms_table(spark: SparkSession, terms: dict[str, list[str]]) -> DataFrame:
    """(category, term) of a small dictionary."""
    rows = [(c, t) for c, ts in terms.items() for t in dict.fromkeys(ts)]
    return spark.createDataFrame(rows, "category string, term string")
