"""Word lists, tables and patterns that must be just these for right results."""

# Fixed values. Lists are in their natural order; nothing here is logic.

#: Tokens of a url that say nothing about a place.
STOP_TOKENS = (
    "ua", "uk", "obyavlenie", "prodazh", "prodazha", "prodam", "prodaetsya", "prodatsya", "kupite", "kvartira", "kvartiru", "kvartiry", "kv", "kvar",
    "kom", "komn", "komnatnaya", "komnatnuyu", "komnatnu", "kimnatna", "kimnatnu", "kmnatna", "kmnatnu", "k", "h", "oh", "1", "2", "3", "4", "5", "6",
    "7", "8", "9", "10", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "m2", "kvm", "m", "tsna", "tsena", "vigdna", "srochnaya",
    "termnoviy", "remont", "program", "programi", "programy", "programme", "programmy", "vaucher", "sertifkat", "eoselya", "vdnovlennya", "gos",
    "derzhyu", "dogovrna", "torg", "vlasnika", "koms", "bez", "mebelyu", "tehnka", "tehnikoyu", "gaz", "kirpich", "tsegla", "tsentr", "centre",
    "rayon", "rn", "r", "po", "na", "v", "u", "z", "s", "o", "so", "ot", "vid", "dlya", "blya", "vozle", "bilya", "novyy", "novomu", "novostroy",
    "zhk", "id", "da", "nyz", "niz", "nizkiy", "sredniy", "sredina", "etazh", "poverh", "visotka", "sotovyy", "proekt", "spetsproekt", "autonomka",
    "avtonomnoe", "avtonomnim", "opalennyam", "otorlenie", "eksklyuziv", "zhiliy", "stan", "beznal", "svoyu", "zatishnu", "otlichnuyu", "idealnaya",
    "idealnuyu", "vasha", "vashe", "morya", "more", "sovremennom", "sovremennyy", "novom", "prostranstvo", "predlagaetsya", "prodazhe", "doma",
    "yaht", "mira", "raschet", "segodnya", "sogodni", "sogodn", "sohodni", "dniprovskyy", "dneprovskiy", "dniprovskiy", "provskiy", "primorskiy",
    "klub", "super", "podhodit", "idem", "mozhno", "krascha", "krasiviy", "balcona", "balkona", "lodzhiya", "mebl", "vlasna", "kotelnya", "dom",
    "dome", "budinku", "dvokmnatna", "trikmnatna", "odnokmnatna", "studiyu", "studiya", "tipa",
)

#: Addresses too vague to keep.
WEAK_ADDRESSES = (
    "дорога", "район", "парк", "ринок", "правий берег", "лівий берег",
)

#: Tokens that a place follows.
PLACE_MARKERS = (
    "ul", "vul", "ulitsa", "prospekt", "prosp", "pr", "prov", "pereulok", "doroga", "bulvar", "bulv", "ploscha", "ploschad", "naberezhnaya", "uzviz",
    "spusk", "zhm", "zh",
)

#: Words for url tokens.
TOKEN_WORDS = {
    "ul": "вул.", "vul": "вул.", "ulitsa": "вул.", "prospekt": "просп.", "prosp": "просп.", "pr": "просп.", "prov": "пров.", "pereulok": "пров.",
    "doroga": "дорога", "bulvar": "бульв.", "bulv": "бульв.", "ploscha": "площа", "ploschad": "площа", "naberezhnaya": "набережна", "uzviz": "узвіз",
    "spusk": "узвіз", "zhm": "ж/м", "zh": "ж/м", "rnzhk": "р-н ЖК", "raen": "район", "rayon": "район", "tairova": "Таїрова", "tairov": "Таїрова",
    "tarova": "Таїрова", "cheremushki": "Черемушки", "cheromushki": "Черемушки", "arkadii": "Аркадія", "arkadiya": "Аркадія", "fontan": "Фонтан",
    "kotovskogo": "Котовського", "slobodka": "Слобідка", "moldavanka": "Молдаванка", "pobeda": "Перемога", "peremoga": "Перемога", "topol": "Тополя",
    "topolya": "Тополя", "levoberezhnyy": "Лівобережний", "slobozhanskiy": "Слобожанський", "kalinovaya": "Калинова", "rabochaya": "Робоча",
    "karavan": "Караван", "parus": "Парус", "kommunar": "Комунар", "krasnyy": "Червоний", "kamen": "Камінь", "tsentre": "Центр", "tsentr": "Центр",
    "pridnprovsk": "Придніпровськ", "pridneprovsk": "Придніпровськ", "manhattan": "Manhattan", "lagom": "Lagom", "akvarel": "Акварель",
    "akropol": "Акрополь", "kontinent": "Континент", "tiras": "Тирас", "avinion": "Avinion", "gavayi": "Гаваї", "zhemchuzhina": "Жемчужина",
    "odesskiy": "Одеський", "dvor": "Двір", "solnechnom": "Сонячний", "levyy": "Лівий", "lviy": "Лівий", "bereg": "берег", "praviy": "Правий",
    "rinok": "ринок", "rynok": "ринок", "obraztsova": "Образцова", "obraztsoviy": "Образцовий", "park": "парк", "parka": "парк", "marka": "Марка",
    "tvena": "Твена", "kosta": "Коста", "kalipso": "Каліпсо", "baku": "Баку", "logos": "Логос", "terra": "Терра", "sich": "Січ",
}

#: Names for url tokens.
KNOWN_NAMES = {
    "bocharova": "Бочарова", "buvalkina": "Бувалкіна", "dobrovolskogo": "Добровольського", "mahachkalinskaya": "Махачкалінська", "zholio": "Жоліо",
    "kyuri": "Кюрі", "lyustdorfskaya": "Люстдорфська", "nebesnoy": "Небесної", "sotne": "Сотні", "saharchova": "Сахарова", "saharova": "Сахарова",
    "zabolotnogo": "Заболотного", "filatova": "Філатова", "kosmonavtov": "Космонавтів", "bolgarskaya": "Болгарська", "balkovskoy": "Балківська",
    "derevyanko": "Дерев'янка", "paliya": "Палія", "dacha": "Дача", "kovalevskogo": "Ковалевського", "vilyamsa": "Вільямса", "generala": "Генерала",
    "vishnevskogo": "Вишневського", "marselska": "Марсельська", "lesi": "Лесі", "ukrainki": "Українки", "kalinova": "Калинова",
    "kalinovaya": "Калинова", "rabochey": "Робоча", "rabochaya": "Робоча", "ivana": "Івана", "mazepy": "Мазепи", "korobova": "Коробова",
    "osmiska": "Осьмака", "osmaka": "Осьмака", "gromova": "Громова", "starochumatskaya": "Старочумацька", "baykalskaya": "Байкальська",
    "yantarna": "Янтарна", "geroev": "Героїв", "polya": "Поля", "shevchenka": "Шевченка", "shmidta": "Шмідта", "benderi": "Бендери",
    "bendery": "Бендери", "kozhemyaki": "Кожем'яки", "bocharov": "Бочарова", "bocharovadobrovolskogo": "Бочарова / Добровольського",
    "arkadiizhk": "Аркадія", "cheremushkahprogrammy": "Черемушки", "cheremushkah": "Черемушки", "cheromushkah": "Черемушки", "krimskomu": "Кримський",
    "olgerda": "Ольгерда", "bochkovskogo": "Бочковського", "starokozatska": "Старокозацька", "nebesno": "Небесної", "sotn": "Сотні",
    "levtana": "Левітана", "vgenya": "Євгенія", "tantsyuri": "Танцюри", "kosmonavtv": "Космонавтів", "malinovskogo": "Малиновського",
    "rabina": "Рабина",
}

#: Month forms and their numbers.
MONTHS = {
    "січ": 1, "січня": 1, "янв": 1, "января": 1, "лют": 2, "лютого": 2, "фев": 2, "февраля": 2, "бер": 3, "березня": 3, "мар": 3, "марта": 3,
    "кві": 4, "квітня": 4, "апр": 4, "апреля": 4, "тра": 5, "травня": 5, "мая": 5, "чер": 6, "червня": 6, "июн": 6, "июня": 6, "лип": 7, "липня": 7,
    "июл": 7, "июля": 7, "сер": 8, "серпня": 8, "авг": 8, "августа": 8, "вер": 9, "вересня": 9, "сен": 9, "сентября": 9, "жов": 10, "жовтня": 10,
    "окт": 10, "октября": 10, "лис": 11, "листопада": 11, "ноя": 11, "ноября": 11, "гру": 12, "грудня": 12, "дек": 12, "декабря": 12,
}

#: Repair labels and the class each belongs to.
REPAIR_CLASSES = {
    "радянський ремонт": "радянський ремонт", "советский ремонт": "радянський ремонт", "житловий стан": "радянський ремонт",
    "жилое состояние": "радянський ремонт", "євроремонт": "євроремонт", "евроремонт": "євроремонт", "капітальний ремонт": "євроремонт",
    "капитальный ремонт": "євроремонт", "дизайнерський ремонт": "євроремонт", "дизайнерский ремонт": "євроремонт", "новий ремонт": "євроремонт",
    "новый ремонт": "євроремонт", "якісний ремонт": "євроремонт", "качественный ремонт": "євроремонт", "під ремонт": "під ремонт",
    "под ремонт": "під ремонт", "без ремонту": "під ремонт", "без ремонта": "під ремонт", "від забудовника": "під ремонт",
    "от строителей": "під ремонт", "косметичний ремонт": "косметичний ремонт", "косметический ремонт": "косметичний ремонт",
}

#: City centres: latitude and longitude.
CITY_CENTERS = {"Одеса": (46.4825, 30.7233), "Дніпро": (48.4674, 35.0407)}

#: Hryvnias for a dollar where no rate is given.
UAH_RATE = 44.15

#: Columns of a raw listing.
LISTING_COLUMNS = (
    "source", "url", "city", "price", "телефон", "adress", "площа", "кількість кімнат", "поверх", "поверховість", "балкон", "район",
    "км від центру", "url_google_maps", "дата публікації", "ремонт", "опис",
)

#: Search pages: source, city, url, base url, collectable over plain HTTP.
SEARCH_PAGES = (
    ("REM.ua", "Одеса", "https://rem.ua/ua/prodazha-kvartir-odessa", "https://rem.ua", True),
    ("REM.ua", "Дніпро", "https://rem.ua/ua/prodazha-kvartir-dnepr", "https://rem.ua", True),
    ("DIM.RIA", "Одеса", "https://dom.ria.com/uk/prodazha-kvartir/odessa-45000usd/", "https://dom.ria.com", True),
    ("DIM.RIA", "Дніпро", "https://dom.ria.com/uk/prodazha-kvartir/dnepr-45000usd/", "https://dom.ria.com", True),
    ("OLX", "Одеса", "https://www.olx.ua/uk/nedvizhimost/kvartiry/prodazha-kvartir/odessa/?currency=USD&search%5Bfilter_float_price:from%5D=35000&search%5Bfilter_float_price:to%5D=45000", "https://www.olx.ua", True),
    ("OLX", "Дніпро", "https://www.olx.ua/uk/nedvizhimost/kvartiry/prodazha-kvartir/dnepr/?currency=USD&search%5Bfilter_float_price:from%5D=35000&search%5Bfilter_float_price:to%5D=45000", "https://www.olx.ua", True),
    ("LUN", "Одеса", "https://lun.ua/sale/odesa/flats-45000-usd", "https://lun.ua", False),
    ("LUN", "Дніпро", "https://lun.ua/sale/dnipro/flats-45000-usd", "https://lun.ua", False),
)

#: Room patterns; group 1 is a digit where a pattern has one.
ROOM_PATTERNS = {
    "digit_k": r"\b([1-5])\s*[- ]?\s*[кk]\b",
    "digit_dash_x": r"\b([1-5])\s*[- ]?\s*[хx]\s*[- ]?\s*(?:комн|кімн|кв|ком|кім)\w*\b",
    "digit_dash_oh": r"\b([1-5])\s*[- ]?\s*о[хx]\s+(?:комн|кімн|кв|ком|кім)\w*\b",
    "digit_room_ua": r"\b([1-5])\s*[- ]?\s*(?:кімн(?:ат(?:а|и|ну|на|ний|них)?)?|кім\.?)\b",
    "digit_room_ru": r"\b([1-5])\s*[- ]?\s*(?:комн(?:ат(?:а|ы|ную|ная|ных)?)?|ком\.?)\b",
    "digit_room_word_ua": r"\b([1-5])\s+(?:кімнатна|кімнатну|кімнатної|кімнатні|кімнати|кімната)\b",
    "digit_no_room_ua": r"\b([1-5])\s*но\s*(?:к[іi]мнатн\w*|к[іi]мн\w*)\b",
    "digit_room_word_ru": r"\b([1-5])\s+(?:комнатная|комнатную|комнатной|комнаты|комната)\b",
    "digit_x": r"\b([1-5])\s*[хx]\b",
    "digit_short_flat": r"\b(?:продам|продаж|продажа)\s+([1-5])\s*(?:кв\.?|квартир[ауиы])\b",
    "word_one_ua": r"\b(?:однокімнатн\w*|однокімн\w*)\b",
    "word_two_ua": r"\b(?:двокімнатн\w*|двокімн\w*)\b",
    "word_three_ua": r"\b(?:трикімнатн\w*|трикімн\w*)\b",
    "word_four_ua": r"\b(?:чотирикімнатн\w*|чотирикімн\w*)\b",
    "word_one_ru": r"\b(?:однокомнатн\w*|однокомн\w*)\b",
    "word_two_ru": r"\b(?:двухкомнатн\w*|двухкомн\w*|двушка|двушк\w*)\b",
    "word_three_ru": r"\b(?:трехкомнатн\w*|трёхкомнатн\w*|трехкомн\w*|трёхкомн\w*|трешка|трёшка|трешк\w*|трёшк\w*)\b",
    "word_four_ru": r"\b(?:четырехкомнатн\w*|четырёхкомнатн\w*|четырехкомн\w*|четырёхкомн\w*)\b",
    "studio": r"\b(?:студія|студію|студия|студию|студийн\w*|смарт|smart)\b",
    "more_than_four": r"\b(?:більше\s*4|более\s*4|5\+)\b",
}

#: What the room patterns without a digit stand for.
ROOM_WORDS = {
    "word_one_ua": "1", "word_one_ru": "1", "word_two_ua": "2", "word_two_ru": "2", "word_three_ua": "3", "word_three_ru": "3",
    "word_four_ua": "4", "word_four_ru": "4", "studio": "1", "more_than_four": "5+",
}

#: Room patterns that score no bonus for their kind.
ROOM_PLAIN = ("digit_x", "studio", "more_than_four")

#: Room patterns over a url's words.
ROOM_URL_PATTERNS = {
    "url_digit_k": r"\b([1-5])\s*[кk]\b",
    "url_digit_room": r"\b([1-5])\s*(?:komn|komnat|kimnat|kmnat)\b",
    "url_studio": r"\b(?:studiya|studiyu|studio|smart)\b",
}

#: Floor patterns; group 1 is the floor, group 2 the number of floors where a pattern has one.
FLOOR_PATTERNS = {
    "floor_of_total_ua": r"\b(\d{1,2})\s*поверх\s*(?:з|із|/)\s*(\d{1,2})\b",
    "floor_of_total_ru": r"\b(\d{1,2})\s*этаж\s*(?:из|с|/)\s*(\d{1,2})\b",
    "floor_slash": r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*(?:пов|поверх|эт|этаж)?\b",
    "floor_before_ua": r"\b(?:на|розташована на|розташований на)\s*(\d{1,2})\s*(?:му|м|й|ому|ий)?\s*поверсі\b",
    "floor_before_ru": r"\b(?:на|расположена на|расположен на)\s*(\d{1,2})\s*(?:м|ом|й)?\s*этаже\b",
    "first_floor_ua": r"\b(?:перший|першому|першім|першого)\s+поверх\w*\b",
    "first_floor_ru": r"\b(?:первый|первом|первого)\s+этаж\w*\b",
    "middle_floor_ua": r"\b(?:середній|средний)\s+поверх\b",
    "middle_floor_ru": r"\b(?:средний)\s+этаж\b",
    "floor_only_ua": r"\b(\d{1,2})\s*поверх\b",
    "floor_only_ru": r"\b(\d{1,2})\s*этаж\b",
}

#: Floor patterns with a number of floors, and those that mean the first floor.
FLOOR_PAIRS = ("floor_of_total_ua", "floor_of_total_ru", "floor_slash")
FLOOR_FIRST = ("first_floor_ua", "first_floor_ru")

#: Floor patterns of detail pages, the first valid pair counts.
DETAIL_FLOOR_PATTERNS = (
    r"Поверх:\s*(\d{1,2})\s+Поверховість:\s*(\d{1,2})",
    r"Этаж:\s*(\d{1,2})\s+Этажность:\s*(\d{1,2})",
    r"\b(\d{1,2})\s*(?:й|ий|ий)?\s*поверх\s*(?:з|із|/)\s*(\d{1,2})\b",
    r"\b(\d{1,2})\s*(?:й|ый)?\s*этаж\s*(?:из|/)\s*(\d{1,2})\b",
    r"\bповерх\s*(\d{1,2})\s*(?:з|із|/)\s*(\d{1,2})\b",
    r"\bэтаж\s*(\d{1,2})\s*(?:из|/)\s*(\d{1,2})\b",
    r"\b(\d{1,2})\s*/\s*(\d{1,2})\s*(?:пов|поверх|эт|этаж)\b",
)
DETAIL_FIRST_FLOOR = r"\b(?:перший|первый)\s+(?:поверх|этаж)\b"

#: Repair patterns over lower-cased text in order; the first that is found names the state.
REPAIR_PATTERNS = (
    (r"без\s+ремонт", "без ремонту"),
    (r"под\s+ремонт|під\s+ремонт|потребує\s+ремонту|требует\s+ремонт", "під ремонт"),
    (r"від\s+будівельник|от\s+строител|стан\s+від\s+будівельник", "від забудовника"),
    (r"состояние\s+от\s+строител", "від забудовника"),
    (r"євроремонт|евроремонт", "євроремонт"),
    (r"капітальн\w*\s+ремонт|капитальн\w*\s+ремонт", "капітальний ремонт"),
    (r"дизайнерськ\w*\s+ремонт|дизайнерск\w*\s+ремонт", "дизайнерський ремонт"),
    (r"нов\w*\s+ремонт|новый\s+ремонт|новий\s+ремонт", "новий ремонт"),
    (r"якісн\w*\s+ремонт|качественн\w*\s+ремонт", "якісний ремонт"),
    (r"косметичн\w*\s+ремонт|косметическ\w*\s+ремонт", "косметичний ремонт"),
    (r"з\s+ремонтом|с\s+ремонтом|ремонт\s+зроблено|ремонт\s+сделан", "є ремонт"),
    (r"житловий\s+стан|жилое\s+состояние|жилая\s+состояние", "житловий стан"),
    (r"ремонт", "ремонт згадується"),
)

#: Patterns of the four repair classes, in the order in which they are tried.
CLASS_PATTERNS = (
    ("під ремонт", (r"під\s+ремонт", r"под\s+ремонт", r"без\s+ремонт", r"потребує\s+ремонту", r"требует\s+ремонт", r"від\s+забудовник", r"от\s+строител", r"стан\s+від\s+будівельник", r"состояние\s+от\s+строител")),
    ("косметичний ремонт", (r"косметичн\w*\s+ремонт", r"косметическ\w*\s+ремонт")),
    ("радянський ремонт", (r"радян\w*\s+ремонт", r"советск\w*\s+ремонт", r"житловий\s+стан", r"жилое\s+состояние", r"стара\s+квартира", r"старый\s+ремонт", r"бабушкин\s+ремонт")),
    ("євроремонт", (r"євроремонт", r"евроремонт", r"дизайнерськ\w*\s+ремонт", r"дизайнерск\w*\s+ремонт", r"нов\w*\s+ремонт", r"новый\s+ремонт", r"сучасн\w*\s+ремонт", r"современн\w*\s+ремонт", r"якісн\w*\s+ремонт", r"качественн\w*\s+ремонт", r"капітальн\w*\s+ремонт", r"капитальн\w*\s+ремонт")),
)

#: What follows one of these marks the date of a listing.
CREATED_MARK = r"(?:опубліковано|опубликовано|додано|добавлено|продаж\s+квартири|продається\s+квартира|продаю\s+квартиру|продам\s+квартиру)\s*(?:[·|:-]\s*)?"

#: Address words left out of the vocabulary, words that mark an address, and words that make one clear.
GENERIC_TOKENS = ("вул", "вулиця", "ул", "улица", "просп", "проспект", "пров", "провулок", "дорога", "бульв", "бульвар", "жм", "ж", "м", "район", "рн", "будинок", "дом")
ADDRESS_MARKERS = ("вул", "вулиця", "ул", "улица", "просп", "проспект", "пров", "провулок", "пер", "переулок", "дорога", "бульв", "бульвар", "площа", "площадь", "ж/м", "жм", "жк", "масив", "массив")
CLEAR_MARKERS = ("вул", "ул", "просп", "пров", "дорога", "бульв", "ж/м", "жк")
SCORED_MARKERS = ("вул", "ул", "улица", "вулиця", "просп", "проспект", "пров", "провулок", "жм", "жк", "дорога", "бульв")
WEAK_SOURCES = ("OLX", "OBYAVA.ua")

#: Candidates that are no address, and existing addresses that may be replaced besides.
BAD_ADDRESSES = (
    "центр", "район", "ремонт", "середній поверх", "новому малоповерховому будинку", "квартира", "продам", "uk / obyavlenie", "ua / ua", "ua", "uk",
    "obyavlenie", "дорога", "парк", "ринок", "правий берег", "лівий берег", "жк ваша идеальная", "жк ваша ідеальная",
)
REPLACEABLE_ADDRESSES = ("центр", "таїрова", "черемушки", "аркадія", "перемога")

#: Address patterns in a description; group 1 is the candidate.
ADDRESS_PATTERNS = (
    r"(?:за адресою|по адресу|адреса|адрес)\s+([^.!?;]{4,90})",
    r"(?:на|по|біля|возле|район|р-н)\s+((?:вул\.?|ул\.?|улиц[аы]|вулиц[яі]|просп\.?|проспект|пров\.?|провулок|пер\.?|переулок|ж/м|жм|ЖК)\s*[^.!?;,$]{3,80})",
    r"((?:вул\.?|ул\.?|улиц[аы]|вулиц[яі]|просп\.?|проспект|пров\.?|провулок|пер\.?|переулок|ж/м|жм|ЖК)\s*[^.!?;,$]{3,80})",
    r"\b([А-ЯІЇЄҐA-Z][А-Яа-яІіЇїЄєҐґA-Za-z']+\s*/\s*[А-ЯІЇЄҐA-Z][А-Яа-яІіЇїЄєҐґA-Za-z']+)\b",
)

#: Patterns of what a candidate address is cut at or freed from, in order; the flag tells if the edges are stripped after it.
ADDRESS_CLEANUPS = (
    (r"[!‼?][\s\S]*$", False),
    (r"\b(?:https?|www|olx|obyava|dom|ria|rem|rieltor|ua|uk|obyavlenie)\b", False),
    (r"\b(?:одеса|дніпро|днепр)\b.*$", True),
    (r"\b(?:\d{2,3}(?:[.,]\d+)?)\s*(?:м²|м2|кв\.?\s*м)\b.*$", True),
    (r"\b(?:\d+)\s*(?:пов|этаж|поверх)\b.*$", True),
    (r"\b(?:пропонується|предлагается|продаж|продажа|продам|квартира|квартири|квартиру)\b.*$", True),
)
ADDRESS_NOISE = (
    r"\b(?:program(?:me|my|y|i)?|da|nizkiy|pod|iz|sredina|raschet|doma|yaht|mira|сегодня|сьогодні)\b",
    r"\b(?:primorskiy|klub|provskiy|dniprovskiy|dneprovskiy)\b",
)

#: Address patterns in a text block of a card; of the first that is found the last match counts.
BLOCK_ADDRESS_PATTERNS = (
    r"((?:вул\.?|вулиця|проспект|просп\.?|провулок|пров\.?|бульвар|бульв\.?|шосе|узвіз|площа)\s+[^,|]{3,80})",
    r"([А-ЯІЇЄҐ][А-Яа-яІіЇїЄєҐґ'’ʼ\-\s]{3,60}\s+(?:вулиця|проспект|провулок|бульвар|шосе),?\s*\d+[А-Яа-яA-Za-zА-ЯІЇЄҐ\-\/]*)",
    r"(ЖК\s+[А-ЯІЇЄҐA-Z][^,|]{2,60})",
    r"(ж/м\s+[А-ЯІЇЄҐA-Z][^,|]{2,60})",
)

#: Patterns of an offer's number in a page, the first that is found counts.
OFFER_PATTERNS = (
    r'"sku"\s*:\s*"(\d{6,})"', r'"id"\s*:\s*(\d{6,})', r"ID:\s*<!--\s*-->\s*(\d{6,})", r"ad-id=(\d{6,})", r"ad-id%3D(\d{6,})",
    r"content_ids\]=(\d{6,})", r"content_ids%5D=(\d{6,})",
)

#: Parts of an image url that mean it is no photo.
IMAGE_SKIPS = ("facebook.com/tr", "google-analytics", "doubleclick", "logo", "avatar", "placeholder", "sprite")

#: What a page says that asks for a check instead of showing listings.
CHALLENGE_MARKERS = ("триває перевірка безпеки", "just a moment", "enable javascript and cookies", "cloudflare")

#: Parts of a page's text that mean the reader was taken for a robot.
BLOCKED_MARKERS = ("підозрілу активність", "suspicious activity", "captcha", "перевірте, що ви не робот", "verify you are human")

#: Numbers that describe a picture, in order.
PICTURE_FEATURES = (
    "rgb_mean_r", "rgb_mean_g", "rgb_mean_b", "rgb_std_r", "rgb_std_g", "rgb_std_b", "hsv_sat_mean", "hsv_sat_std", "hsv_val_mean", "hsv_val_std", "gray_mean", "gray_std",
    "edge_density", "laplacian_var", "dark_ratio", "bright_ratio", "neutral_ratio", "colorfulness", "entropy", *(f"hist_{c}_{k}" for c in "rgb" for k in range(8)),
)

#: Gradients from which an edge is weak and strong; gray below and above which a pixel is dark and bright; saturation below which it is neutral.
EDGE_LEVELS, DARK, BRIGHT, NEUTRAL = (80, 160), 45, 215, 0.12

#: Weights of red, green and blue in gray, of 2^15; the tangent of 22.5 degrees, of 2^15.
LUMA_WEIGHTS, TANGENT_22 = (9798, 19235, 3735), 13573

#: Pictures below this size are not kept.
LEAST_WIDTH, LEAST_HEIGHT = 160, 120

#: The least probability of a picture model's answer, and pictures of a listing that are looked at.
LEAST_CONFIDENCE, MOST_PICTURES = 0.62, 4

#: How a reader of pages names itself.
USER_AGENT = "brickyard/1.0 (listing reader)"
ACCEPT_LANGUAGE = "uk-UA,uk;q=0.9,en;q=0.8"

#: The id in a spreadsheet's address, where its service is, its cells at most, rows sent at once, and the color of a header.
SHEET_URL = r"/spreadsheets/d/([a-zA-Z0-9-_]+)"
SHEET_ENDPOINT = "https://sheets.googleapis.com"
SHEET_CELLS, SHEET_BATCH = 10_000_000, 2_000
SHEET_HEADER_COLOR = (0.88, 0.94, 1.0)

#: Least scores of the models' answers, and sources whose addresses are always taken from their urls.
LEAST_SCORES = {"address": 2.2, "rooms": 1.6, "floor": 1.7}
REPLACE_ADDRESS_SOURCES = ("OLX",)

#: Dates in texts: by number, by a month's name, so many hours ago, and a time of day.
DATE_ISO = r"\b(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?\b"
DATE_NUMERIC = r"\b(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})(?:\s+(\d{1,2}):(\d{2}))?\b"
DATE_NAMED = r"\b(\d{1,2})\s+([а-яіїєґ]+)\.?(?:\s+(\d{4}))?(?:\s*(?:р\.?|року|г\.?))?(?:\s*(?:о|в)?\s*(\d{1,2}):(\d{2}))?"
DATE_HOURS_AGO = r"\b(\d{1,2})\s+(?:годин|години|годину|час(?:ов|а)?)\s+тому\b"
CLOCK = r"(?U)\d{1,2}:\d{2}"

#: Dates of detail pages: a stamp in the source, exact and loose marks, and a day by name.
DETAIL_STAMP = r"\b(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2})(?::(\d{2}))?\b"
DETAIL_MARKS = r"(?:Створений|Створено|Создан|Создано|Опубліковано|Опубликовано|Оновлений|Оновлено|Обновлен|Обновлено)\s*:\s*"
DETAIL_EXACT = DETAIL_MARKS + r"(\d{2})-(\d{2})-(\d{4})\s+(\d{2}):(\d{2}):(\d{2})"
DETAIL_LOOSE = DETAIL_MARKS + r"(\d{2})[./](\d{2})[./](\d{4})(?:\s+(\d{2}):(\d{2})(?::(\d{2}))?)?"
DETAIL_DAY = r"Опубліковано\s+(\d{1,2})\s+([а-яіїєґ]+)\s+(\d{4})\s*р\.?"
