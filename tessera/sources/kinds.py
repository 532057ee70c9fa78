"""Kinds of entities: the folder that holds them, their prefix, base types, category and place in the tree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metadata folders, the kind each holds, the prefix of qualified names, and the base type of its objects.
FOLDERS = {
    "Catalogs": ("Catalog", "Справочники", "СправочникОбъект"),
    "Documents": ("Document", "Документы", "ДокументОбъект"),
    "ChartsOfCharacteristicTypes": ("ChartOfCharacteristicTypes", "ПланыВидовХарактеристик", "ПланВидовХарактеристикОбъект"),
    "ChartsOfAccounts": ("ChartOfAccounts", "ПланыСчетов", "ПланСчетовОбъект"),
    "ChartsOfCalculationTypes": ("ChartOfCalculationTypes", "ПланыВидовРасчета", "ПланВидовРасчетаОбъект"),
    "InformationRegisters": ("InformationRegister", "РегистрыСведений", "РегистрСведенийНаборЗаписей"),
    "AccumulationRegisters": ("AccumulationRegister", "РегистрыНакопления", "РегистрНакопленияНаборЗаписей"),
    "AccountingRegisters": ("AccountingRegister", "РегистрыБухгалтерии", "РегистрБухгалтерииНаборЗаписей"),
    "CalculationRegisters": ("CalculationRegister", "РегистрыРасчета", "РегистрРасчетаНаборЗаписей"),
    "BusinessProcesses": ("BusinessProcess", "БизнесПроцессы", None),
    "Tasks": ("Task", "Задачи", None),
    "ExchangePlans": ("ExchangePlan", "ПланыОбмена", None),
    "Constants": ("Constant", "Константы", "КонстантаМенеджерЗначения"),
    "Enums": ("Enum", "Перечисления", "ПеречислениеСсылка"),
    "Reports": ("Report", "Отчеты", "ОтчетОбъект"),
    "DataProcessors": ("DataProcessor", "Обработки", "ОбработкаОбъект"),
    "DocumentJournals": ("DocumentJournal", "ЖурналыДокументов", "ЖурналДокументовОбъект"),
    "CommonModules": ("CommonModule", "ОбщиеМодули", None),
    "CommonForms": ("CommonForm", "ОбщиеФормы", None),
}
# Names of simple types.
TYPE_NAMES = {"xs:string": "Строка", "xs:boolean": "Булево", "xs:decimal": "Число", "xs:dateTime": "ДатаВремя"}
# The category that a kind is shown under; other kinds are under Other.
CATEGORIES = {
    "Primitive": "PrimitiveTypes",
    "Array": "Collections",
    "Structure": "Collections",
    "Map": "Collections",
    "ValueList": "Collections",
    "ValueTable": "TabularData",
    "ValueTree": "TabularData",
    "Catalog": "Catalogs",
    "Document": "Documents",
    "InformationRegister": "InformationRegisters",
    "AccumulationRegister": "AccumulationRegisters",
    "ChartOfCharacteristicTypes": "ChartsOfCharacteristicTypes",
    "ChartOfAccounts": "ChartsOfAccounts",
    "ChartOfCalculationTypes": "ChartsOfCalculationTypes",
    "Enum": "Enums",
    "Report": "Reports",
    "DataProcessor": "DataProcessors",
    "BusinessProcess": "BusinessProcesses",
    "Task": "Tasks",
    "CommonModule": "CommonModules",
    "Global": "GlobalContext",
    "System": "SystemTypes",
    "Form": "Forms",
}
# Places of categories; one without a place comes after all others.
PLACES = {
    "PrimitiveTypes": 1,
    "Collections": 2,
    "TabularData": 3,
    "GlobalContext": 4,
    "Catalogs": 10,
    "Documents": 11,
    "InformationRegisters": 12,
    "AccumulationRegisters": 13,
    "Enums": 20,
    "CommonModules": 30,
    "Reports": 40,
    "DataProcessors": 41,
    "Forms": 50,
    "SystemTypes": 90,
    "Other": 99,
}
LAST_PLACE = 999
# Kinds of platform types by either name; other names are System.
TYPE_KINDS = {
    "Массив": "Array",
    "Array": "Array",
    "Структура": "Structure",
    "Structure": "Structure",
    "Соответствие": "Map",
    "Map": "Map",
    "СписокЗначений": "ValueList",
    "ValueList": "ValueList",
    "ТаблицаЗначений": "ValueTable",
    "ValueTable": "ValueTable",
    "ДеревоЗначений": "ValueTree",
    "ValueTree": "ValueTree",
    "Число": "Primitive",
    "Number": "Primitive",
    "Строка": "Primitive",
    "String": "Primitive",
    "Булево": "Primitive",
    "Boolean": "Primitive",
    "Дата": "Primitive",
    "Date": "Primitive",
}
# Where code runs, by either name; other names are dropped.
CONTEXTS = {
    "Клиент": "Client",
    "Сервер": "Server",
    "ВнешнееСоединение": "ExternalConnection",
    "МобильноеПриложение": "MobileApp",
    "МобильныйКлиент": "MobileClient",
    "МобильныйСервер": "MobileServer",
    "ТолстыйКлиент": "ThickClient",
    "ТонкийКлиент": "ThinClient",
    "ВебКлиент": "WebClient",
}
# What stands in a manager's type name, its base type and its kind; the first that is there counts.
MANAGERS = (
    ("Справочники", "СправочникМенеджер", "Справочник"),
    ("CatalogsManager", "СправочникМенеджер", "Справочник"),
    ("СправочникиМенеджер", "СправочникМенеджер", "Справочник"),
    ("DocumentsManager", "ДокументМенеджер", "Документ"),
    ("МенеджерДокументов", "ДокументМенеджер", "Документ"),
    ("InformationRegistersManager", "РегистрСведенийМенеджер", "Регистр сведений"),
    ("МенеджерРегистровСведений", "РегистрСведенийМенеджер", "Регистр сведений"),
    ("AccumulationRegistersManager", "РегистрНакопленияМенеджер", "Регистр накопления"),
    ("МенеджерРегистровНакопления", "РегистрНакопленияМенеджер", "Регистр накопления"),
    ("DataProcessorsManager", "ОбработкаМенеджер", "Обработка"),
    ("МенеджерОбработок", "ОбработкаМенеджер", "Обработка"),
    ("ReportsManager", "ОтчетМенеджер", "Отчет"),
    ("МенеджерОтчетов", "ОтчетМенеджер", "Отчет"),
    ("ConstantsManager", "КонстантаМенеджер", "Константа"),
    ("МенеджерКонстант", "КонстантаМенеджер", "Константа"),
)
# Global names of the script and the platform types that they stand for.
ALIASES = {
    "ПользователиИнформационнойБазы": "МенеджерПользователейИнформационнойБазы (InfoBaseUsersManager)",
    "InfoBaseUsers": "МенеджерПользователейИнформационнойБазы (InfoBaseUsersManager)",
    "Метаданные": "МенеджерМетаданных",
    "Metadata": "MetadataManager",
    "Константы": "МенеджерКонстант",
    "Constants": "ConstantsManager",
    "Справочники": "СправочникиМенеджер (CatalogsManager)",
    "Catalogs": "СправочникиМенеджер (CatalogsManager)",
    "Документы": "МенеджерДокументов",
    "Documents": "DocumentsManager",
    "РегистрыСведений": "МенеджерРегистровСведений",
    "InformationRegisters": "InformationRegistersManager",
    "РегистрыНакопления": "МенеджерРегистровНакопления",
    "AccumulationRegisters": "AccumulationRegistersManager",
    "Обработки": "МенеджерОбработок",
    "DataProcessors": "DataProcessorsManager",
    "Отчеты": "МенеджерОтчетов",
    "Reports": "ReportsManager",
}


def mapped(key: Column, table: dict[str, str | int]) -> Column:
    """The entry of a small table, null where there is none."""
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def category(kind: Column) -> Column:
    return F.coalesce(mapped(kind, CATEGORIES), F.lit("Other"))


def category_place(name: Column) -> Column:
    return F.coalesce(mapped(name, PLACES), F.lit(LAST_PLACE))


def prefix(kind: Column) -> Column:
    return F.coalesce(mapped(kind, {k: p for k, p, _ in FOLDERS.values()}), F.lit("Прочие"))


def parent_types(kind: Column) -> Column:
    """Base types of a kind's objects: one or none."""
    return F.array_compact(F.array(mapped(kind, {k: b for k, _, b in FOLDERS.values() if b})))


def type_kind(name: Column) -> Column:
    return F.coalesce(mapped(name, TYPE_KINDS), F.lit("System"))


def contexts(names: Column) -> Column:
    """Contexts of an array of names in either language, unknown ones dropped."""
    known = CONTEXTS | {v: v for v in CONTEXTS.values()}
    return F.array_compact(F.transform(names, lambda n: mapped(n, known)))


def manager_type(type_name: Column, member: Column) -> Column:
    """The type of manager.member, such as the manager of one catalog; null where type_name is no manager."""
    base = F.coalesce(*(F.when(F.contains(type_name, F.lit(p)), F.lit(b)) for p, b, _ in MANAGERS))
    return F.concat(base, F.lit("."), member)
