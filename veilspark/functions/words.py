"""Word lists of the rules.  Longer ones, such as names of publicly known persons, are parameters and empty by default."""

from __future__ import annotations

# They decide results and must not be changed.
FIRST_NAMES = (
    "александр", "алексей", "андрей", "анна", "антон", "артём", "артем", "борис", "вадим", "валентина", "валерий",
    "василий", "вера", "виктор", "виктория", "владимир", "владислав", "вячеслав", "галина", "георгий", "григорий",
    "даниил", "данил", "денис", "дмитрий", "евгений", "екатерина", "елена", "елизавета", "иван", "игорь", "илья", "инна",
    "ирина", "кирилл", "константин", "ксения", "лариса", "лев", "леонид", "людмила", "максим", "марина", "мария", "михаил",
    "надежда", "наталья", "николай", "нина", "олег", "ольга", "павел", "пётр", "петр", "раиса", "роман", "светлана",
    "сергей", "станислав", "степан", "тамара", "татьяна", "тимофей", "фёдор", "федор", "юлия", "юрий", "яков", "ярослав",
)
LAST_NAMES = (
    "абрамов", "авдеев", "александров", "алексеев", "андреев", "анисимов", "антонов", "артемьев", "архипов", "афанасьев",
    "баранов", "белов", "беляев", "богданов", "болдырев", "бородин", "быков", "васильев", "веселов", "виноградов",
    "волков", "воробьев", "воронцов", "гаврилов", "герасимов", "голубев", "гончаров", "горбунов", "гордеев", "григорьев",
    "данилов", "денисов", "дмитриев", "дорофеев", "дроздов", "егоров", "ершов", "ефимов", "жданов", "жуков", "зайцев",
    "захаров", "зверев", "золотов", "иванов", "игнатьев", "ильин", "кабанов", "казаков", "калашников", "калинин",
    "капустин", "карпов", "киселев", "князев", "ковалев", "козлов", "колесников", "колобов", "комаров", "королев",
    "кошелев", "кузнецов", "кузьмин", "куликов", "лебедев", "леонов", "лихачев", "лобанов", "логинов", "лукин", "макаров",
    "максимов", "мальцев", "марков", "мартынов", "маслов", "матвеев", "медведев", "мельников", "меркулов", "миронов",
    "михайлов", "молчанов", "морозов", "назаров", "никитин", "николаев", "никонов", "новиков", "носов", "орлов", "осипов",
    "павлов", "панов", "петров", "петухов", "плотников", "покровский", "поляков", "попов", "потапов", "прохоров",
    "родионов", "рожков", "романов", "рыбаков", "савельев", "савин", "сафонов", "семенов", "сергеев", "сидоров", "смирнов",
    "соболев", "соколов", "соловьев", "сорокин", "степанов", "суворов", "тарасов", "титов", "тихонов", "третьяков",
    "трофимов", "уваров", "федоров", "филатов", "филиппов", "фомин", "фролов", "харитонов", "цветков", "чернов",
    "чернышев", "шаров", "шестаков", "ширяев", "щукин", "юдин", "яковлев", "якушев",
)
COUNTRIES = (
    "россия", "российская федерация", "рф", "ссср", "украина", "беларусь", "республика беларусь", "республики беларусь",
    "белоруссия", "казахстан", "республика казахстан", "республики казахстан", "узбекистан", "таджикистан", "киргизия",
    "кыргызстан", "туркменистан", "азербайджан", "армения", "республика армения", "республики армения", "грузия",
    "молдова", "молдавия", "литва", "латвия", "эстония", "польша", "республика польша", "республики польша", "германия",
    "франция", "италия", "испания", "португалия", "великобритания", "сша", "соединенные штаты", "соединённые штаты",
    "канада", "китай", "китайская народная республика", "япония", "индия", "бразилия", "аргентина", "мексика", "турция",
    "израиль", "египет", "финляндия", "швеция", "норвегия", "дания", "нидерланды", "бельгия", "швейцария", "австрия",
    "чехия", "словакия", "венгрия", "румыния", "болгария", "сербия", "хорватия", "греция", "кипр", "мальта", "люксембург",
    "ирландия", "исландия", "австралия", "новая зеландия", "южная корея", "северная корея", "вьетнам", "таиланд",
    "индонезия", "малайзия", "сингапур", "филиппины", "пакистан", "афганистан", "иран", "ирак", "сирия",
    "саудовская аравия", "оаэ", "катар", "кувейт", "бахрейн", "оман", "иордания", "ливан", "монголия", "непал",
    "шри-ланка", "бангладеш", "мьянма", "камбоджа", "лаос", "куба", "венесуэла", "колумбия", "перу", "чили", "уругвай",
    "парагвай", "боливия", "эквадор", "панама", "коста-рика", "гватемала", "гондурас", "никарагуа", "сальвадор",
    "доминикана", "гаити", "ямайка", "тринидад", "багамы", "барбадос", "юар", "южная африка", "нигерия", "кения",
    "эфиопия", "танзания", "уганда", "гана", "сенегал", "марокко", "алжир", "тунис", "ливия", "судан", "ангола",
    "мозамбик", "замбия", "зимбабве", "ботсвана", "намибия", "мадагаскар", "маврикий",
)
CITIZENSHIP_KEYWORDS = (
    "гражданство", "гражданин", "гражданка", "гражданином", "гражданкой", "подданство", "национальность",
)
BIRTH_PLACE_KEYWORDS = (
    "место рождения", "родился", "родилась", "родился в", "родилась в", "место рождения:", "уроженец", "уроженка",
    "родом из",
)
BIRTH_DATE_KEYWORDS = (
    "дата рождения", "родился", "родилась", "день рождения", "год рождения", "дата рождения:", "родился ", "родилась ",
)
ISSUE_DATE_KEYWORDS = (
    "дата выдачи", "выдан", "выдано", "паспорт выдан", "дата выдачи:", "выдан ", "выдано ",
)
PASSPORT_ISSUER_KEYWORDS = (
    "выдан", "выдано", "орган", "органом", "кем выдан", "кем выдан:", "выдавший", "выдавший документ", "отделом",
    "управлением", "отделением",
)
DEPARTMENT_CODE_KEYWORDS = (
    "код подразделения", "код подразделения:", "подразделение", "код", "паспорт", "паспорта", "отдел", "отделение",
    "управление", "овм", "омвд", "умвд", "мвд",
)
FULL_NAME_KEYWORDS = (
    "фио", "ф.и.о", "ф. и. о", "клиент", "заявитель", "держатель", "заёмщик", "заемщик", "поручитель", "сотрудник",
    "работник", "пациент", "студент", "абонент", "пользователь", "владелец", "представитель", "гражданин", "гражданка",
    "имя", "фамилия", "отчество", "полное имя", "полное имя:", "имя:", "фамилия:", "отчество:", "ф.и.о.:", "фио:",
    "данные клиента", "данные заявителя", "данные держателя",
)
CARDHOLDER_KEYWORDS = (
    "cardholder", "card holder", "держатель карты", "на карте указано", "на карте", "имя на карте", "имя на карте:",
    "cardholder name", "cardholder:", "держатель карты:", "на карте указано:", "держатель", "держатель:",
)
BANK_CONTEXT_KEYWORDS = (
    "карта", "карты", "карте", "карту", "банк", "банка", "банковская", "банковской", "платежная", "платёжная", "платежной",
    "платёжной", "cvv", "cvc", "cvv2", "cvc2", "пин", "пин-код", "пин код", "pin", "pin-код", "pin код", "код",
    "код доступа", "код подтверждения", "счет", "счёт", "счета", "счёта", "оплата", "оплаты", "платеж", "платёж",
    "платежа", "платёжа", "перевод", "перевода", "реквизиты", "реквизиты карты", "номер карты", "номер счета",
    "номер счёта", "срок действия", "действует до", "valid", "expiry", "expiration", "банкомат", "терминал",
    "интернет-банк", "интернет банк", "мобильный банк",
)
ADDRESS_KEYWORDS = (
    "адрес", "адрес:", "адрес проживания", "адрес регистрации", "адрес регистрации:", "адрес проживания:",
    "место жительства", "место жительства:", "место регистрации", "место регистрации:", "проживает", "проживает по адресу",
    "зарегистрирован", "зарегистрирована", "зарегистрирован по адресу", "зарегистрирована по адресу", "прописан",
    "прописана", "прописан по адресу", "прописана по адресу", "местонахождение", "местонахождение:", "зарегистрирован:",
    "зарегистрирована:", "проживает:",
)
ADDRESS_STRUCTURE_KEYWORDS = (
    "город", "г.", "г ", "улица", "ул.", "ул ", "проспект", "пр-т", "пр.", "переулок", "пер.", "пер ", "бульвар", "б-р",
    "шоссе", "ш.", "набережная", "наб.", "площадь", "пл.", "дом", "д.", "д ", "корпус", "корп.", "к.", "строение", "стр.",
    "квартира", "кв.", "кв ", "офис", "оф.", "область", "обл.", "обл ", "край", "республика", "район", "р-н", "поселок",
    "посёлок", "пос.", "деревня", "дер.", "село", "с.", "микрорайон", "мкр.", "индекс", "почтовый индекс", "индекс:",
    "почтовый индекс:",
)
PASSPORT_CONTEXT_KEYWORDS = (
    "паспорт", "паспорта", "паспорте", "паспортом", "паспорт рф", "паспорт гражданина", "удостоверение", "документ",
    "документа", "документе", "серия", "номер паспорта", "серия паспорта", "паспортные данные", "паспортные данные:",
    "данные паспорта", "серия и номер", "серия и номер паспорта",
)
DRIVER_LICENSE_KEYWORDS = (
    "водительское удостоверение", "водительские права", "права", "водительское удостоверение:", "водительские права:",
    "права:", "удостоверение водителя", "в/у", "в у", "водительское", "ву", "ву:", "водительское удостоверение:",
)
INN_KEYWORDS = (
    "инн", "инн:", "иин", "идентификационный номер налогоплательщика", "идентификационный номер налогоплательщика:",
    "налоговый номер", "налоговый номер:", "инн физического лица", "инн физического лица:",
)
PHONE_KEYWORDS = (
    "телефон", "телефон:", "тел.", "тел ", "мобильный", "мобильный телефон", "мобильный телефон:", "номер телефона",
    "номер телефона:", "сотовый", "сотовый телефон", "сотовый телефон:", "контактный телефон", "контактный телефон:",
    "звонить", "позвонить", "позвоните", "свяжитесь", "связаться", "whatsapp", "telegram", "viber",
)
EMAIL_KEYWORDS = (
    "email", "e-mail", "электронная почта", "электронная почта:", "почта", "почта:", "email:", "e-mail:", "эл. почта",
    "эл. почта:", "электронный адрес", "электронный адрес:", "адрес электронной почты", "адрес электронной почты:",
)
CARD_NUMBER_KEYWORDS = (
    "номер карты", "номер карты:", "номер банковской карты", "номер банковской карты:", "карта", "карты", "карте", "карту",
    "банковская карта", "банковской карты", "платежная карта", "платёжная карта", "платежной карты", "платёжной карты",
    "счет", "счёт", "счета", "счёта", "реквизиты карты", "реквизиты карты:", "номер счета", "номер счёта", "номер счета:",
    "номер счёта:",
)
CVV_KEYWORDS = (
    "cvv", "cvc", "cvv2", "cvc2", "код безопасности", "код безопасности:", "защитный код", "защитный код:",
    "код с обратной стороны", "код с обратной стороны:", "трехзначный код", "трёхзначный код", "трехзначный код:",
    "трёхзначный код:", "код на обороте", "код на обороте:", "security code", "verification code",
)
PIN_KEYWORDS = (
    "пин", "пин-код", "пин код", "пин-код:", "пин код:", "пин:", "pin", "pin-код", "pin код", "pin:", "pin-код:",
    "pin код:", "пароль от карты", "пароль от карты:", "пин-код карты", "пин-код карты:", "пин карты", "пин карты:",
)
ORDER_NUMBER_KEYWORDS = (
    "заказ", "заказа", "заказу", "номер заказа", "номер заказа:", "заявка", "заявки", "номер заявки", "номер заявки:",
    "трек-номер", "трек номер", "трек-номер:", "трек номер:", "номер накладной", "номер накладной:", "артикул", "артикул:",
    "номер договора", "номер договора:", "договор", "договора", "счет-фактура", "счет-фактура:", "счёт-фактура",
    "счёт-фактура:", "квитанция", "квитанции", "номер квитанции", "номер квитанции:",
)
AUDITORIUM_KEYWORDS = (
    "аудитория", "аудитория:", "кабинет", "кабинет:", "комната", "комната:", "офис", "офис:", "помещение", "помещение:",
    "ауд.", "ауд ",
)
ORDER_ARTICLE_KEYWORDS = (
    "заказ", "заказа", "заказу", "номер заказа", "номер заказа:", "заявка", "заявки", "номер заявки", "номер заявки:",
    "артикул", "артикул:", "артикула", "номер артикула", "номер артикула:", "трек-номер", "трек номер", "трек-номер:",
    "трек номер:", "номер накладной", "номер накладной:", "номер договора", "номер договора:", "договор", "договора",
    "счет-фактура", "счет-фактура:", "счёт-фактура", "счёт-фактура:", "квитанция", "квитанции", "номер квитанции",
    "номер квитанции:", "партия", "партии", "номер партии", "номер партии:", "серийный номер", "серийный номер:",
    "серийный", "серийного",
)
METRO_TRANSPORT_KEYWORDS = (
    "метро", "метрополитен", "транспортная карта", "транспортной карты", "проездной", "проездного", "проездная",
    "проездной билет", "карта метро", "карты метро", "тройка", "стрелка", "подорожник", "транспортная", "транспортной",
    "проезд",
)
LOYALTY_CARD_KEYWORDS = (
    "лояльности", "лояльность", "дисконтная", "дисконтной", "скидочная", "скидочной", "бонусная", "бонусной",
    "накопительная", "накопительной", "карта лояльности", "карты лояльности", "дисконтная карта", "дисконтной карты",
    "скидочная карта", "скидочной карты", "бонусная карта", "бонусной карты", "подарочная карта", "подарочной карты",
    "клубная карта", "клубной карты",
)
NON_BANK_CVV_KEYWORDS = (
    "замка", "замок", "домофон", "домофона", "кодовый замок", "кодового замка", "сейф", "сейфа", "шкафчик", "шкафчика",
    "камера хранения", "камеры хранения", "ячейка", "ячейки", "код от замка", "код от домофона", "код от сейфа",
)
NON_BANK_PIN_KEYWORDS = (
    "телефона", "телефон", "сим-карта", "сим-карты", "сим карта", "сим карты", "sim-карта", "sim-карты", "от телефона",
    "от сим-карты", "от сим карты", "код от телефона", "пин от телефона", "пин-код от телефона", "пин от сим-карты",
    "пин-код от сим-карты", "роутер", "роутера", "wi-fi", "wifi", "wi-fi роутер", "wi-fi роутера", "от роутера",
    "пин от роутера", "пин-код от роутера",
)
BANK_BRANCH_KEYWORDS = (
    "отделение банка", "отделения банка", "офис банка", "офиса банка", "филиал банка", "филиала банка", "банк находится",
    "банк расположен", "отделение сбербанка", "отделение втб", "отделение альфа-банка", "отделение альфа банка",
    "банкомат", "банкомата", "терминал оплаты", "терминала оплаты", "пункт выдачи", "пункта выдачи", "магазин находится",
    "магазин расположен", "офис компании", "офиса компании",
)
PUBLIC_CONTACT_KEYWORDS = (
    "служба поддержки", "службы поддержки", "поддержка", "поддержки", "горячая линия", "горячей линии", "колл-центр",
    "колл-центра", "call-центр", "call-центра", "call center", "справочная", "справочной", "информационная линия",
    "информационной линии", "контактный центр", "контактного центра", "официальный сайт", "официального сайта", "на сайте",
    "на нашем сайте", "наш сайт", "наш телефон", "наш email", "наша почта", "наша электронная почта", "для связи",
    "для обращений", "обращайтесь", "позвоните нам", "напишите нам", "телефон доверия", "телефона доверия", "единый номер",
    "единого номера", "бесплатный номер", "бесплатного номера", "8-800", "8800", "8 800", "техподдержка", "техподдержки",
    "техническая поддержка", "технической поддержки", "клиентская поддержка", "клиентской поддержки", "офис", "офиса",
    "офис компании", "офиса компании", "компании", "компания", "организации", "организация", "фирмы", "фирма",
    "телефон офиса", "телефон компании", "телефон организации", "email компании", "email организации", "почта компании",
    "почта организации", "контакты компании", "контакты организации", "отдел продаж", "отдела продаж", "отдел кадров",
    "отдела кадров", "отдел поддержки", "отдела поддержки", "бухгалтерия", "бухгалтерии", "приёмная", "приемная",
    "приёмной", "приемной", "секретарь", "секретаря", "менеджер", "менеджера", "менеджер по продажам",
    "менеджера по продажам",
)
PUBLIC_PLACE_KEYWORDS = (
    "ресторан", "ресторана", "кафе", "магазин", "магазина", "супермаркет", "супермаркета", "аптека", "аптеки", "салон",
    "салона", "парикмахерская", "парикмахерской", "фитнес-клуб", "фитнес-клуба", "спортзал", "спортзала", "кинотеатр",
    "кинотеатра", "театр", "театра", "музей", "музея", "библиотека", "библиотеки", "школа", "школы", "университет",
    "университета", "институт", "института", "больница", "больницы", "поликлиника", "поликлиники", "клиника", "клиники",
    "отель", "отеля", "гостиница", "гостиницы", "банк", "банка", "отделение банка", "отделения банка", "офис банка",
    "офиса банка", "филиал", "филиала", "офис", "офиса", "офис компании", "офиса компании", "представительство",
    "представительства", "склад", "склада", "производство", "производства", "завод", "завода", "фабрика", "фабрики",
    "центр", "центра", "торговый центр", "торгового центра", "тц", "аэропорт", "аэропорта", "вокзал", "вокзала", "станция",
    "станции", "метро", "парк", "парка", "площадь", "площади", "улица", "улицы", "проспект", "проспекта", "находится",
    "расположен", "расположена", "расположено", "находится по адресу", "расположен по адресу", "расположена по адресу",
    "расположено по адресу",
)

# Parameters.
KNOWN_PERSON_NAMES: tuple[str, ...] = ()
KNOWN_PERSON_CONTEXT: tuple[str, ...] = ()
