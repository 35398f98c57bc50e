"""Parameters of every operator. Defaults are the production values."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values -------------------------------------------------------------
COUNTRIES = ("USA", "UK", "Germany", "France", "Japan")
PAYMENT_METHODS = ("Credit Card", "Debit Card", "PayPal", "Apple Pay", "Google Pay")
CART_EVENT_TYPES = ("add_to_cart", "remove_from_cart", "update_quantity", "checkout", "cart_abandonment")
VIEW_EVENT_TYPES = ("view", "search", "filter", "compare")
CATEGORIES = (
    # Electronics
    "Smartphones", "Laptops", "Tablets", "Desktop Computers", "Monitors",
    "Keyboards", "Mice", "Headphones", "Speakers", "Cameras",
    "Smart Watches", "Fitness Trackers", "Gaming Consoles", "VR Headsets", "Drones",
    "Printers", "Scanners", "External Hard Drives", "USB Drives", "Webcams",
    # Clothing & Fashion
    "Men's T-Shirts", "Men's Jeans", "Men's Jackets", "Men's Shoes", "Men's Accessories",
    "Women's Dresses", "Women's Tops", "Women's Jeans", "Women's Shoes", "Women's Accessories",
    "Kids' Clothing", "Baby Clothing", "Sportswear", "Swimwear", "Underwear",
    "Socks", "Belts", "Hats", "Scarves", "Gloves",
    # Home & Kitchen
    "Furniture", "Bedding", "Curtains", "Rugs", "Lighting",
    "Kitchen Appliances", "Cookware", "Dinnerware", "Cutlery", "Glassware",
    "Storage & Organization", "Cleaning Supplies", "Home Decor", "Wall Art", "Mirrors",
    "Bathroom Accessories", "Towels", "Pillows", "Blankets", "Mattresses",
    # Books & Media
    "Fiction Books", "Non-Fiction Books", "E-Books", "Audiobooks", "Magazines",
    "Movies", "Music CDs", "Vinyl Records", "Video Games", "Board Games",
    # Sports & Outdoors
    "Exercise Equipment", "Yoga Mats", "Dumbbells", "Treadmills", "Bicycles",
    "Camping Gear", "Hiking Equipment", "Fishing Gear", "Sports Balls", "Athletic Shoes",
    # Beauty & Personal Care
    "Skincare", "Makeup", "Hair Care", "Fragrances", "Nail Care",
    "Bath & Body", "Shaving Products", "Oral Care", "Personal Hygiene", "Beauty Tools",
    # Toys & Games
    "Action Figures", "Dolls", "Building Blocks", "Puzzles", "Educational Toys",
    "Remote Control Toys", "Stuffed Animals", "Arts & Crafts", "Musical Toys", "Outdoor Toys",
)
#: (country, region, continent, currency, timezone)
GEOGRAPHY_ROWS = (
    ("USA", "North America", "Americas", "USD", "America/New_York"),
    ("UK", "Western Europe", "Europe", "GBP", "Europe/London"),
    ("Germany", "Western Europe", "Europe", "EUR", "Europe/Berlin"),
    ("France", "Western Europe", "Europe", "EUR", "Europe/Paris"),
    ("Japan", "East Asia", "Asia", "JPY", "Asia/Tokyo"),
)
PEAK_HOURS = (10, 11, 12, 13, 14, 19, 20, 21)
NORMAL_HOURS = (8, 9, 15, 16, 17, 18, 22)
PRICE_BANDS = ((0, 50), (50, 100), (100, 200), (200, 500), (500, 1000), (1000, 2000))
#: Ordered: the first type with a keyword inside the lower-cased category wins.
CATEGORY_KEYWORDS = (
    ("electronics", ("laptop", "computer", "phone", "tablet", "camera", "console", "drone", "watch")),
    ("clothing", ("shirt", "jean", "jacket", "shoe", "dress", "clothing")),
    ("home", ("furniture", "bedding", "kitchen", "appliance")),
    ("books", ("book", "movie", "music", "game")),
    ("sports", ("exercise", "sport", "yoga", "bicycle", "camping")),
    ("beauty", ("skincare", "makeup", "beauty", "fragrance")),
)
CATEGORY_DEFAULT_TYPE = "toys"
SEGMENT_TEXT = (
    ("Champions", "Best customers with high recency, frequency, and monetary value"),
    ("Loyal Customers", "Consistent customers with good recency and frequency"),
    ("Big Spenders", "Customers with high monetary value"),
    ("Promising", "Recent customers with low frequency"),
    ("At Risk", "Customers who haven't purchased recently but had good frequency"),
    ("Lost", "Inactive customers with low recency and frequency"),
    ("Regular", "Average customers who don't fit other segments"),
)
SEGMENT_UNKNOWN = "Unknown segment"
OPEN_END = "9999-12-31 23:59:59"
# ------------------------------------------------------------------------------


#: fixed value: a pause of so long ends a user's session
SESSION_TIMEOUT = "30 minutes"


@dataclass(frozen=True)
class Windowing:
    """Width, slide and allowed lateness of one windowed operator."""
    width: str
    slide: str | None = None
    lateness: str = "1 minute"


@dataclass(frozen=True)
class Realtime:
    """Windows and thresholds of the event-time operators."""
    sales: Windowing = Windowing("1 minute")
    cart_sessions: Windowing = Windowing("5 minutes", lateness="5 minutes")
    abandonment: Windowing = Windowing("30 minutes", "10 minutes", "30 minutes")
    cart_metrics: Windowing = Windowing("1 minute")
    trending: Windowing = Windowing("5 minutes", lateness="5 minutes")
    categories: Windowing = Windowing("1 minute")
    searches: Windowing = Windowing("5 minutes", lateness="5 minutes")
    browsing: Windowing = Windowing("10 minutes", lateness="10 minutes")
    anomalies: Windowing = Windowing("1 minute")
    suspicious: Windowing = Windowing("1 minute")
    velocity: Windowing = Windowing("5 minutes", lateness="5 minutes")
    demand: Windowing = Windowing("10 minutes", lateness="10 minutes")
    restock: Windowing = Windowing("5 minutes", lateness="5 minutes")
    inventory: Windowing = Windowing("1 minute")
    trending_min_views: int = 5
    search_min_count: int = 3
    high_value: tuple[float, float] = (3000, 10000)
    high_quantity: tuple[int, int] = (50, 100)
    suspicious_min_amount: float = 1000
    suspicious_min_count: int = 2
    demand_units: tuple[int, int, int] = (20, 30, 50)
    restock_rates: tuple[float, float, float] = (1.0, 2.0, 3.0)
    restock_rate_unit: str = "1 minute"
    fast_moving_quantity: int = 10


@dataclass(frozen=True)
class Scoring:
    """Cuts of the customer and product scores; cut lists run from best to worst."""
    recency_days: tuple[int, int, int, int] = (30, 60, 90, 180)
    frequency: tuple[int, int, int, int] = (10, 7, 4, 2)
    monetary: tuple[float, float, float, float] = (1000, 500, 250, 100)
    spend_segments: tuple[float, float, float] = (1000, 500, 100)
    tier_ranks: tuple[int, int, int] = (10, 50, 200)


@dataclass(frozen=True)
class Vocabulary:
    """Allowed values used by event validation."""
    countries: tuple[str, ...] = COUNTRIES
    payment_methods: tuple[str, ...] = PAYMENT_METHODS
    categories: tuple[str, ...] = CATEGORIES
    cart_event_types: tuple[str, ...] = CART_EVENT_TYPES
    view_event_types: tuple[str, ...] = VIEW_EVENT_TYPES


REALTIME = Realtime()
SCORING = Scoring()
VOCABULARY = Vocabulary()
