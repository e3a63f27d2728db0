"""Values that results depend on, in one place.

Everything below is a fixed value: key names, labels, confidences, patterns and
schedules that must stay as they are for results to stay comparable.
"""

# --- fixed values: JSON-LD keys -> field names ---------------------------------
JSON_LD_SCALARS = (
    ("name", "name"),
    ("description", "description"),
    ("email", "email"),
    ("telephone", "telephone"),
)
JSON_LD_ADDRESS = (
    ("streetAddress", "street_address"),
    ("addressLocality", "city"),
    ("addressRegion", "state"),
    ("addressCountry", "country"),
    ("postalCode", "postal_code"),
)
JSON_LD_PRODUCT = (
    ("name", "product_name"),
    ("category", "category"),
)

# --- fixed values: OpenGraph properties -> field names ---------------------------
OPEN_GRAPH = (
    ("og:title", "name"),
    ("og:site_name", "name"),
    ("og:description", "description"),
)

# --- fixed values: field whitelists ----------------------------------------------
BUSINESS_FIELDS = (
    "name", "description", "street_address", "city", "state", "country", "postal_code",
)
PRODUCT_FIELDS = ("product_name", "category")

# --- fixed values: confidence per extraction method ----------------------------------
JSON_LD_CONFIDENCE = 0.92
OPEN_GRAPH_CONFIDENCE = 0.75
META_CONFIDENCE = 0.55
MAILTO_CONFIDENCE = 0.97
TEL_CONFIDENCE = 0.95
TEXT_EMAIL_CONFIDENCE = 0.6
SOCIAL_LINK_CONFIDENCE = 0.85
SAME_AS_CONFIDENCE = 0.92
GENERATOR_CONFIDENCE = 0.95

# --- fixed values: social domains, tried in this order ---------------------------------
SOCIAL_DOMAINS = (
    ("instagram.com", "instagram"),
    ("facebook.com", "facebook"),
    ("tiktok.com", "tiktok"),
    ("linkedin.com", "linkedin"),
    ("x.com", "x"),
    ("twitter.com", "x"),
    ("youtube.com", "youtube"),
    ("pinterest.com", "pinterest"),
)
SOCIAL_PLATFORMS = ("instagram", "facebook", "tiktok", "linkedin", "x", "youtube", "pinterest")

# --- fixed values: store platform signals, tried in this order ---------------------------
# (platform, pattern, confidence, method); patterns ignore case.
PLATFORM_SIGNALS = (
    ("shopify", r"cdn\.shopify\.com", 0.97, "shopify-cdn-asset"),
    ("shopify", r"Shopify\.shop\s*=", 0.97, "shopify-js-global"),
    ("shopify", r"myshopify\.com", 0.90, "myshopify-domain-reference"),
    ("shopify", r"name=[\"']shopify-digital-wallet[\"']", 0.90, "shopify-meta-tag"),
    ("woocommerce", r"wp-content/plugins/woocommerce", 0.95, "woocommerce-plugin-path"),
    ("woocommerce", r"woocommerce", 0.80, "woocommerce-asset-reference"),
    ("wordpress", r"name=[\"']generator[\"']\s+content=[\"']WordPress", 0.95, "wordpress-generator-tag"),
    ("wordpress", r"wp-content/", 0.75, "wp-content-path"),
    ("wix", r"static\.wixstatic\.com", 0.95, "wix-static-asset"),
    ("squarespace", r"squarespace\.com", 0.90, "squarespace-asset-reference"),
    ("webflow", r"webflow\.com", 0.90, "webflow-asset-reference"),
    ("bigcommerce", r"bigcommerce\.com", 0.90, "bigcommerce-asset-reference"),
    ("magento", r"Magento|/skin/frontend/", 0.80, "magento-signal"),
)
UNKNOWN_PLATFORM = "unknown"

# --- fixed values: page types, tried in this order ---------------------------------------
# (page type, priority, path pattern); patterns ignore case.
PAGE_TYPES = (
    ("contact", 0.95, r"/(contact|contact-us)/?$"),
    ("about", 0.90, r"/(about|about-us)/?$"),
    ("products", 0.85, r"/(products?)(/|$)"),
    ("collection", 0.80, r"/(collections?|categories?)(/|$)"),
    ("blog", 0.30, r"/(blogs?|news)(/|$)"),
    ("privacy", 0.10, r"/(privacy|terms|legal)"),
)
HOMEPAGE_PRIORITY = 1.0
DEFAULT_PAGE_PRIORITY = 0.10
MAX_PAGES_PER_DOMAIN = 10

# --- fixed values: text rules ---------------------------------------------------------------
TEXT_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MIN_VISIBLE_TEXT = 50

# --- fixed values: crawl outcomes -----------------------------------------------------------
BLOCKING_STATUS_CODES = (403, 429)
MAX_ATTEMPTS = 5
STALE_CLAIM_MINUTES = 30
CANDIDATE_BACKOFF_MINUTES = (2, 8, 32, 120, 480)

# --- fixed values: email verification ---------------------------------------------------------
VERIFICATION_BACKOFF_MINUTES = (5, 30, 120, 720, 2880)
VERIFICATION_LEASE_MINUTES = 15
VERIFICATION_PROVIDER = "dns-mx-check"

# --- fixed values: entity resolution -----------------------------------------------------------
SAME_DOMAIN_SCORE = 1.0
SHARED_CONTACT_SCORE = 0.85
AUTO_MERGE_AT = 0.95
POSSIBLE_DUPLICATE_AT = 0.75
MATCH_CANDIDATE_LIMIT = 20

# --- fixed values: limits -----------------------------------------------------------------------
DISCOVERY_LIMIT = 100
RETRY_BATCH = 100
EXPORT_LIMIT = 500

# --- fixed values: validation messages ------------------------------------------------------------
MISSING_NAME = "missing business name"
NO_REACHABLE_CONTACT = "no contacts or social profiles found"

# --- fixed values: vocabularies ----------------------------------------------------------------
CANDIDATE_STATES = ("pending", "crawling", "success", "retry", "blocked", "abandoned")
CRAWL_STATUSES = ("success", "failed", "blocked", "timeout")
PAGE_TYPE_NAMES = (
    "homepage", "contact", "about", "products", "collection", "blog", "privacy", "other",
)
FETCHED_VIA = ("http", "browser")
MERGE_STATUSES = ("active", "possible_duplicate", "merged")
RESOLUTION_ACTIONS = ("create_new", "auto_merge", "flag_possible_duplicate")
VERIFICATION_STATUSES = ("pending", "verified", "risky", "invalid", "unknown")
CONTACT_TYPES = ("email", "phone")

# --- fixed values: area codes of the North American numbering plan, by where they serve ---
AREA_CODES = {
    "Alabama": "205 251 256 334 659 938",
    "Alaska": "907",
    "Arizona": "480 520 602 623 928",
    "Arkansas": "327 479 501 870",
    "California": "209 213 279 310 323 341 350 357 369 408 415 424 442 510 530 559 562 619 626 628 650 657 661 669 707 714"
                  " 747 760 805 818 820 831 837 840 858 909 916 925 949 951",
    "Colorado": "303 719 720 748 970 983",
    "Connecticut": "203 475 860 959",
    "Delaware": "302",
    "District of Columbia": "202 771",
    "Florida": "239 305 321 324 352 386 407 448 561 645 656 689 727 728 754 772 786 813 850 863 904 941 954",
    "Georgia": "229 404 470 478 678 706 762 770 912 943",
    "Hawaii": "808",
    "Idaho": "208 986",
    "Illinois": "217 224 309 312 331 447 464 618 630 708 730 773 779 815 847 861 872",
    "Indiana": "219 260 317 463 574 765 812 930",
    "Iowa": "319 515 563 641 712",
    "Kansas": "316 620 785 913",
    "Kentucky": "270 364 502 606 859",
    "Louisiana": "225 318 337 457 504 985",
    "Maine": "207",
    "Maryland": "227 240 301 410 443 667",
    "Massachusetts": "339 351 413 508 617 774 781 857 978",
    "Michigan": "231 248 269 313 517 586 616 679 734 810 906 947 989",
    "Minnesota": "218 320 507 612 651 763 924 952",
    "Mississippi": "228 471 601 662 769",
    "Missouri": "235 314 417 557 573 636 660 816 975",
    "Montana": "406",
    "Nebraska": "308 402 531",
    "Nevada": "702 725 775",
    "New Hampshire": "603",
    "New Jersey": "201 551 609 640 732 848 856 862 908 973",
    "New Mexico": "505 575",
    "New York": "212 315 329 332 347 363 516 518 585 607 624 631 646 680 716 718 838 845 914 917 929 934",
    "North Carolina": "252 336 472 704 743 828 910 919 980 984",
    "North Dakota": "701",
    "Ohio": "216 220 234 283 326 330 380 419 436 440 513 567 614 740 937",
    "Oklahoma": "405 539 572 580 918",
    "Oregon": "458 503 541 971",
    "Pennsylvania": "215 223 267 272 412 445 484 570 582 610 717 724 814 835 878",
    "Rhode Island": "401",
    "South Carolina": "803 821 839 843 854 864",
    "South Dakota": "605",
    "Tennessee": "423 615 629 731 865 901 931",
    "Texas": "210 214 254 281 325 346 361 409 430 432 469 512 621 682 713 726 737 806 817 830 832 903 915 936 940 945 956"
             " 972 979",
    "Utah": "385 435 801",
    "Vermont": "802",
    "Virginia": "276 434 540 571 686 703 757 804 826 948",
    "Washington": "206 253 360 425 509 564",
    "West Virginia": "304 681",
    "Wisconsin": "262 274 353 414 534 608 715 920",
    "Wyoming": "307",
    "American Samoa": "684",
    "Guam": "671",
    "Northern Mariana Islands": "670",
    "Puerto Rico": "787 939",
    "US Virgin Islands": "340",
    "Alberta": "368 403 587 780 825",
    "British Columbia": "236 250 257 604 672 778",
    "Manitoba": "204 431 584",
    "New Brunswick": "428 506",
    "Newfoundland and Labrador": "709 879",
    "Northwest Territories, Nunavut, Yukon": "867",
    "Nova Scotia, Prince Edward Island": "782 902",
    "Ontario": "226 249 289 343 365 382 416 437 519 548 613 647 683 705 742 753 807 905 942",
    "Quebec": "263 354 367 418 438 450 468 514 579 581 819 873",
    "Saskatchewan": "306 474 639",
    "Anguilla": "264",
    "Antigua and Barbuda": "268",
    "Bahamas": "242",
    "Barbados": "246",
    "Bermuda": "441",
    "British Virgin Islands": "284",
    "Cayman Islands": "345",
    "Dominica": "767",
    "Dominican Republic": "809 829 849",
    "Grenada": "473",
    "Jamaica": "658 876",
    "Montserrat": "664",
    "Saint Kitts and Nevis": "869",
    "Saint Lucia": "758",
    "Saint Vincent and the Grenadines": "784",
    "Sint Maarten": "721",
    "Trinidad and Tobago": "868",
    "Turks and Caicos Islands": "649",
    "personal numbers": "500 521 522 523 524 525 526 527 528 529 533 544 566 577 588",
    "Canadian services": "600 622 633 644 655 677 688",
    "toll-free numbers": "800 833 844 855 866 877 888",
    "premium numbers": "900",
}

# --- fixed values: calling codes other than 1, with the lengths of their national numbers and the digits they begin with ---
NATIONAL_NUMBERS = """
7 10 346789
20 8-10 1-9
27 9 1-9
30 10 2-9
31 7-11 1-9
32 8-9 1-9
33 9 1-9
34 9 5-9
36 8-9 1-9
39 6-12 0-9
40 9 2-9
41 9,12 2-9
43 4-13 1-9
44 7,9-10 1-35789
45 8 2-9
46 6-10 1-9
47 5,8 02-9
48 9 1-9
49 4-13 1-9
51 8-9 1-9
52 10 1-9
53 6-8,10 2-8
54 10-11 1-9
55 8-11 1-9
56 9-11 1-9
57 8,10-11 1-9
58 10 2-9
60 8-10 1-9
61 6-10 1-9
62 7-13 1-9
63 6-13 1-9
64 8-10 2-9
65 8,10-11 136789
66 8-10,13 1-9
81 8-12 1-9
82 5-12 1-9
84 7-10 1-9
86 7-12 1-9
90 7,10,12 2-9
91 8-13 1-9
92 8-12 1-9
93 9 2-7
94 9 1-9
95 6-10 1-9
98 4-10 1-9
211 9 19
212 9 5-8
213 8-9 1-9
216 8 2-9
218 8-9 2-9
220 7 2-9
221 9 3789
222 8 2-48
223 8 24-9
224 8-9 3679
225 10 02
226 8 02-7
227 8 027-9
228 8 279
229 8,10 024-9
230 7-8,10 2-9
231 7-9 2-9
232 8 2-9
233 8-9 2-9
234 6-11 1-9
235 8 26-9
236 8 278
237 8-9 2689
238 7 2-59
239 7 29
240 9 235-9
241 7-8 0-7
242 9 02-8
243 7-10 1-9
244 9 29
245 7,9 4-9
246 7 3
247 5-6 1-9
248 7 2-9
249 9 19
250 8-9 027
251 9 1-9
252 6-9 1-9
253 8 27
254 7-10 1-9
255 7-9 2-9
256 9 2-9
257 8 2367
258 8-9 28
260 9 257-9
261 7,9 23
262 9 2689
263 5-10 1-9
264 8-10 68
265 7,9 127-9
266 8 25-8
267 7-8,10 02-9
268 8-9 0237-9
269 7 3478
290 4-5 2-8
291 7 178
297 7 25-9
298 6 2-9
299 6 2-9
350 8 256
351 9 1-9
352 4-11 2-9
353 7-10 1-9
354 7,9 3-9
355 6-9 2-9
356 8 2-9
357 8 2-9
358 5-12 1-9
359 6-12 2-9
370 8 3-9
371 8 26-9
372 7-10 3-9
373 8 235-9
374 8 1-9
375 6-11 1-9
376 6,8-9 136-9
377 8-9 3-9
378 6-10 01356-8
380 9-10 3-9
381 6-12 1-9
382 8-9 2-9
383 8-12 2-9
385 7-9 1-9
386 5-8 1-9
387 8-9 3-9
389 8 2-9
420 9,12 2-9
421 6-9 2-9
423 7,9 2-9
500 5 2-7
501 7,11 02-8
502 8,11 1-8
503 7-8,11 2-9
504 8,11 2-9
505 8 1-8
506 8,10 24-9
507 7-11 1-9
508 6,9 4-9
509 8 2-9
590 9 5-9
591 8-9 2-8
592 7 2-9
593 8-11 1-9
594 9 5-9
595 6-11 2-9
596 9 5-9
597 6-7 2-8
598 6-13 024-9
599 7-8 3-9
670 7-8 2-9
672 5-6 13
673 7 2-8
674 7 4-8
675 7-8 1-9
676 5,7 2-9
677 5,7 1-9
678 5,7 2-9
679 7,11 02-9
680 7 2-9
681 6,9 4-8
682 5 2-8
683 4,7 4-9
685 5-7,10 2-9
686 5,8 2-9
687 6 2-9
688 5-7 279
689 6,8-9 489
690 4-5,7 2-9
691 7 39
692 7 2-6
800 8 1-9
808 8 1-9
850 6-10 1-9
852 5-9 2-9
853 7-8 0268
855 8-10 1-9
856 8-10 2-9
870 9,12 2357
878 12 1
880 6-10 1-9
881 9 06-9
882 7-12 139
883 8-15 25
886 7-11 2-9
888 11 0-9
960 7,10 3-9
961 7-8 2-9
962 8-9 2-9
963 8-9 1-59
964 8-10 1-7
965 7-8 1-9
966 8-10 1-9
967 7-9 1-7
968 7-9 1-9
970 8-10 1-9
971 5-12 2-9
972 7-12 1-9
973 8 13679
974 7-11 2-8
975 7-8 1-8
976 8-10 1-9
977 8-11 1-9
979 9 1-9
992 9 0-9
993 8 1-7
994 9 1-9
995 9 3-9
996 9-10 2-9
998 9 02-9
"""
