"""Literal word lists for readable names and places (own lists, see README)."""

FIRST_NAMES = [
    "Ada", "Alan", "Amir", "Anna", "Arjun", "Beth", "Carlos", "Chen", "Clara", "Dario",
    "Diana", "Elif", "Emil", "Erika", "Fatima", "Felix", "Grace", "Hana", "Hugo", "Ines",
    "Ivan", "Jonas", "Julia", "Kofi", "Lara", "Leo", "Lina", "Marco", "Maya", "Mina",
    "Nadia", "Noah", "Olga", "Omar", "Paula", "Priya", "Rosa", "Samuel", "Tara", "Yusuf",
]
LAST_NAMES = [
    "Adler", "Bauer", "Becker", "Castro", "Chandra", "Clarke", "Costa", "Dalton", "Duarte", "Eriksen",
    "Fischer", "Foster", "Gomez", "Grant", "Haddad", "Hansen", "Hughes", "Ito", "Jensen", "Keller",
    "Khan", "Kowalski", "Larsen", "Lopez", "Mbeki", "Meyer", "Moreau", "Nakamura", "Nguyen", "Novak",
    "O'Brien", "Okafor", "Park", "Patel", "Quinn", "Rossi", "Sato", "Silva", "Weber", "Young",
]
CITIES = [
    "Ashford", "Bay Ridge", "Bellmont", "Briar Hill", "Brookfield", "Cedar Falls", "Clayton", "Clearwater", "Crestview", "Dover Plains",
    "East Haven", "Edgewood", "Elm Grove", "Fairview", "Forest Lake", "Glenwood", "Grand Prairie", "Greenfield", "Harbor Point", "Hazelton",
    "Highland Park", "Hillsboro", "Iron Springs", "Kingston", "Lakewood", "Lexington", "Linden", "Maple Ridge", "Marshfield", "Meadowbrook",
    "Millbrook", "New Haven", "North Shore", "Oakdale", "Orchard Park", "Palm Grove", "Pine Bluff", "Port Arbor", "Quarry Hill", "Red Oak",
    "Ridgefield", "River Bend", "Rockport", "Salem", "Sandy Creek", "Shelby", "South Fork", "Spring Valley", "Stonebridge", "Summit",
    "Sunnyside", "Thornton", "Union City", "Vernon", "Walnut Creek", "Waverly", "Westfield", "Willow Bay", "Winslow", "Yorktown",
]
STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
]
WORDS = [
    "Amber", "Arrow", "Atlas", "Breeze", "Cobalt", "Coral", "Crystal", "Delta", "Ember", "Falcon",
    "Fern", "Flint", "Garnet", "Granite", "Harbor", "Horizon", "Indigo", "Ivory", "Jasper", "Juniper",
    "Lotus", "Lunar", "Maple", "Meteor", "Nova", "Onyx", "Opal", "Orbit", "Pebble", "Prism",
    "Quartz", "Raven", "Sable", "Sierra", "Solar", "Summit", "Timber", "Topaz", "Velvet", "Zephyr",
]
COMPANY_SUFFIXES = ["Group", "Inc", "LLC", "Ltd", "Partners", "Systems"]
EMAIL_DOMAINS = ["example.com", "example.net", "example.org"]
ROUTE_CITY_COUNT = 30  # fixed value: routes link this many places
