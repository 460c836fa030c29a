"""Word lists for generated strings. All lists are fixed values of this project."""

from __future__ import annotations

WORDS = [
    "amber", "basin", "cedar", "delta", "ember", "fable", "grove", "harbor", "islet", "jolt", "kernel", "lumen",
    "meadow", "nickel", "orchid", "pebble", "quartz", "ripple", "saddle", "timber", "umbra", "velvet", "willow", "zephyr",
]
STREETS = ["Mill", "Station", "Harbor", "Oak", "Church", "Garden", "River", "Summit"]
DOMAINS = ["example.com", "example.org", "example.net"]
JOB_TITLES = ["Analyst", "Engineer", "Manager", "Designer", "Clerk", "Auditor"]
DEPARTMENTS = ["Finance", "Sales", "Research", "Support", "Logistics"]
COMPANY_FORMS = ["Ltd", "Group", "Partners", "Works"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "BRL", "INR"]
STATES = ["North", "South", "East", "West", "Central"]
ENUM_VALUES = ["ACTIVE", "INACTIVE", "PENDING", "COMPLETE"]

# locale -> country, first names, last names, cities
LOCALES = {
    "en_US": ("United States", ["James", "Mary", "Linda"], ["Carter", "Brooks", "Hayes"], ["Denver", "Austin", "Boston"]),
    "en_GB": ("United Kingdom", ["Oliver", "Amelia", "Harry"], ["Wright", "Clarke", "Shaw"], ["Leeds", "Bristol", "York"]),
    "es_ES": ("España", ["Lucía", "Hugo", "Marta"], ["García", "Romero", "Vidal"], ["Sevilla", "Bilbao", "Málaga"]),
    "fr_FR": ("France", ["Camille", "Louis", "Inès"], ["Moreau", "Lefèvre", "Garnier"], ["Lyon", "Nantes", "Lille"]),
    "de_DE": ("Deutschland", ["Anna", "Lukas", "Jürgen"], ["Schmidt", "Weber", "Krüger"], ["Köln", "Bremen", "Leipzig"]),
    "it_IT": ("Italia", ["Giulia", "Marco", "Sofia"], ["Rossi", "Conti", "Ferri"], ["Torino", "Bologna", "Verona"]),
    "pt_BR": ("Brasil", ["João", "Beatriz", "Rafael"], ["Souza", "Barbosa", "Lima"], ["Recife", "Curitiba", "Natal"]),
    "ja_JP": ("日本", ["陽菜", "蓮", "葵"], ["佐藤", "鈴木", "高橋"], ["札幌", "横浜", "京都"]),
    "ko_KR": ("대한민국", ["서연", "민준", "지우"], ["김", "이", "박"], ["부산", "대구", "인천"]),
    "zh_CN": ("中国", ["伟", "芳", "娜"], ["王", "李", "张"], ["成都", "武汉", "西安"]),
    "ru_RU": ("Россия", ["Анна", "Иван", "Ольга"], ["Иванова", "Петров", "Орлов"], ["Казань", "Омск", "Томск"]),
    "ar_SA": ("السعودية", ["محمد", "فاطمة", "علي"], ["الحربي", "القحطاني", "الغامدي"], ["جدة", "الدمام", "تبوك"]),
    "hi_IN": ("भारत", ["आरव", "अनन्या", "रोहन"], ["शर्मा", "वर्मा", "पटेल"], ["जयपुर", "पुणे", "इंदौर"]),
}
DEFAULT_LOCALE = "en_US"
