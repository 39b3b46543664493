"""Province list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.province import province_dim

# Plate, name, region, latitude, longitude, population.
PROVINCES = """
1, Adana, Akdeniz, 37.00, 35.32, 2258718
2, Adıyaman, Güneydoğu Anadolu, 37.76, 38.27, 634169
3, Afyonkarahisar, Ege, 38.75, 30.55, 732784
4, Ağrı, Doğu Anadolu, 39.72, 43.05, 504178
5, Amasya, Karadeniz, 40.65, 35.83, 339756
6, Ankara, İç Anadolu, 39.93, 32.85, 5747325
7, Antalya, Akdeniz, 36.90, 30.70, 2619832
8, Artvin, Karadeniz, 41.18, 41.82, 172838
9, Aydın, Ege, 37.85, 27.85, 1148241
10, Balıkesir, Marmara, 39.65, 27.89, 1258296
11, Bilecik, Marmara, 40.15, 29.97, 231185
12, Bingöl, Doğu Anadolu, 38.88, 40.50, 279738
13, Bitlis, Doğu Anadolu, 38.40, 42.12, 337789
14, Bolu, Karadeniz, 40.74, 31.61, 324979
15, Burdur, Akdeniz, 37.73, 30.29, 271124
16, Bursa, Marmara, 40.18, 29.06, 3101833
17, Çanakkale, Marmara, 40.15, 26.41, 560563
18, Çankırı, Karadeniz, 40.60, 33.62, 199027
19, Çorum, Karadeniz, 40.55, 34.95, 503490
20, Denizli, Ege, 37.78, 29.09, 1054809
21, Diyarbakır, Güneydoğu Anadolu, 37.91, 40.23, 1804880
22, Edirne, Marmara, 41.68, 26.56, 420234
23, Elazığ, Doğu Anadolu, 38.68, 39.22, 587225
24, Erzincan, Doğu Anadolu, 39.75, 39.49, 234359
25, Erzurum, Doğu Anadolu, 39.91, 41.27, 749411
26, Eskişehir, İç Anadolu, 39.78, 30.52, 909864
27, Gaziantep, Güneydoğu Anadolu, 37.06, 37.38, 2154051
28, Giresun, Karadeniz, 40.91, 38.39, 433324
29, Gümüşhane, Karadeniz, 40.46, 39.48, 175963
30, Hakkari, Doğu Anadolu, 37.58, 43.74, 296243
31, Hatay, Akdeniz, 36.40, 36.10, 1694194
32, Isparta, Akdeniz, 37.76, 30.56, 440285
33, Mersin, Akdeniz, 36.80, 34.64, 1916432
34, İstanbul, Marmara, 41.01, 28.95, 15840900
35, İzmir, Ege, 38.42, 27.14, 4425789
36, Kars, Doğu Anadolu, 40.60, 43.10, 282536
37, Kastamonu, Karadeniz, 41.38, 33.78, 371186
38, Kayseri, İç Anadolu, 38.72, 35.49, 1441523
39, Kırklareli, Marmara, 41.74, 27.22, 383202
40, Kırşehir, İç Anadolu, 39.14, 34.17, 238525
41, Kocaeli, Marmara, 40.76, 29.93, 2081320
42, Konya, İç Anadolu, 37.87, 32.49, 2320312
43, Kütahya, Ege, 39.42, 29.98, 554200
44, Malatya, Doğu Anadolu, 38.35, 38.33, 800638
45, Manisa, Ege, 38.62, 27.43, 1428485
46, Kahramanmaraş, Akdeniz, 37.59, 36.93, 1204898
47, Mardin, Güneydoğu Anadolu, 37.31, 40.74, 851239
48, Muğla, Ege, 37.21, 28.36, 1062432
49, Muş, Doğu Anadolu, 38.75, 41.49, 404044
50, Nevşehir, İç Anadolu, 38.62, 34.72, 299685
51, Niğde, İç Anadolu, 37.97, 34.68, 375529
52, Ordu, Karadeniz, 40.98, 37.88, 768423
53, Rize, Karadeniz, 41.02, 40.52, 361612
54, Sakarya, Marmara, 40.69, 30.44, 1077351
55, Samsun, Karadeniz, 41.29, 36.33, 1368884
56, Siirt, Güneydoğu Anadolu, 37.93, 41.94, 349260
57, Sinop, Karadeniz, 42.03, 35.15, 211012
58, Sivas, İç Anadolu, 39.75, 37.02, 641166
59, Tekirdağ, Marmara, 40.98, 27.51, 1101472
60, Tokat, Karadeniz, 40.32, 36.56, 588739
61, Trabzon, Karadeniz, 41.00, 39.73, 818306
62, Tunceli, Doğu Anadolu, 39.11, 39.55, 83645
63, Şanlıurfa, Güneydoğu Anadolu, 37.17, 38.80, 2173783
64, Uşak, Ege, 38.68, 29.41, 385953
65, Van, Doğu Anadolu, 38.49, 43.38, 1136372
66, Yozgat, İç Anadolu, 39.82, 34.81, 396511
67, Zonguldak, Karadeniz, 41.46, 31.79, 606447
68, Aksaray, İç Anadolu, 38.37, 34.03, 437879
69, Bayburt, Karadeniz, 40.26, 40.23, 84922
70, Karaman, İç Anadolu, 37.18, 33.22, 257185
71, Kırıkkale, İç Anadolu, 39.85, 33.51, 269754
72, Batman, Güneydoğu Anadolu, 37.88, 41.13, 653698
73, Şırnak, Güneydoğu Anadolu, 37.52, 42.46, 533595
74, Bartın, Karadeniz, 41.64, 32.34, 200295
75, Ardahan, Doğu Anadolu, 41.11, 42.70, 100311
76, Iğdır, Doğu Anadolu, 39.92, 44.05, 196110
77, Yalova, Marmara, 40.66, 29.27, 299395
78, Karabük, Karadeniz, 41.20, 32.62, 247449
79, Kilis, Güneydoğu Anadolu, 36.72, 37.12, 163463
80, Osmaniye, Akdeniz, 37.21, 36.18, 555607
81, Düzce, Karadeniz, 40.84, 31.16, 412804
"""


def read_provinces(spark: SparkSession) -> DataFrame:
    """The 81 provinces; small enough to join by broadcast."""
    rows = []
    for line in PROVINCES.strip().splitlines():
        plate, name, region, lat, lng, people = (part.strip() for part in line.split(","))
        rows.append((int(plate), name, region, float(lat), float(lng), int(people)))
    raw = spark.createDataFrame(
        rows, "plate int, name string, region string, lat double, lng double, population bigint")
    return province_dim(raw)
