"""Dimensions of airlines: small fixed tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Airline codes and names.
AIRLINES = """
6E IndiGo
AI Air India
UK Vistara
SG SpiceJet
G8 Go First
QP Akasa Air
I5 AirAsia India
IX Air India Express
S5 Star Air
2T TruJet
8Y Pan Pacific Airlines
E5 Air Arabia India
EK Emirates
EY Etihad Airways
QR Qatar Airways
FZ flydubai
WY Oman Air
GF Gulf Air
SV Saudia
XY flynas
G9 Air Arabia
KU Kuwait Airways
RJ Royal Jordanian
ME Middle East Airlines
SQ Singapore Airlines
TG Thai Airways
MH Malaysia Airlines
GA Garuda Indonesia
CX Cathay Pacific
PR Philippine Airlines
VN Vietnam Airlines
KE Korean Air
OZ Asiana Airlines
NH ANA (All Nippon Airways)
JL Japan Airlines
CI China Airlines
BR EVA Air
CZ China Southern Airlines
MU China Eastern Airlines
CA Air China
HU Hainan Airlines
3K Jetstar Asia
TR Scoot
AK AirAsia
FD Thai AirAsia
QZ Indonesia AirAsia
UL SriLankan Airlines
RA Nepal Airlines
BG Biman Bangladesh Airlines
PK Pakistan International Airlines
WS WestJet
BA British Airways
LH Lufthansa
AF Air France
KL KLM Royal Dutch Airlines
LX SWISS
OS Austrian Airlines
AZ ITA Airways
IB Iberia
SK SAS Scandinavian Airlines
AY Finnair
TK Turkish Airlines
LO LOT Polish Airlines
TP TAP Air Portugal
EI Aer Lingus
SN Brussels Airlines
RO TAROM
JU Air Serbia
OU Croatia Airlines
FR Ryanair
U2 easyJet
W6 Wizz Air
VY Vueling
DY Norwegian Air
AA American Airlines
UA United Airlines
DL Delta Air Lines
WN Southwest Airlines
B6 JetBlue Airways
AS Alaska Airlines
NK Spirit Airlines
F9 Frontier Airlines
HA Hawaiian Airlines
AC Air Canada
AM Aeromexico
LA LATAM Airlines
AV Avianca
CM Copa Airlines
G3 Gol Linhas Aéreas
QF Qantas
NZ Air New Zealand
VA Virgin Australia
JQ Jetstar
ET Ethiopian Airlines
SA South African Airways
MS EgyptAir
KQ Kenya Airways
AT Royal Air Maroc
WB RwandAir
"""

# Three-letter airline codes and what they stand for.
AIRLINE_ALIASES = """
IGO 6E
AIC AI
VTI UK
SEJ SG
GOW G8
AKJ QP
IAD I5
AIX IX
AXB IX
SDG S5
UAE EK
ETD EY
QTR QR
FDB FZ
OMA WY
GFA GF
SVA SV
KAC KU
RJA RJ
MEA ME
ABY G9
SIA SQ
THA TG
MAS MH
GIA GA
CPA CX
PAL PR
HVN VN
KAL KE
AAR OZ
ANA NH
JAL JL
CAL CI
EVA BR
CSN CZ
CES MU
CCA CA
CHH HU
JSA 3K
TGW TR
AXM AK
AIQ FD
AWQ QZ
ALK UL
RNA RA
BBC BG
PIA PK
WJA WS
BAW BA
DLH LH
AFR AF
KLM KL
SWR LX
AUA OS
ITY AZ
IBE IB
SAS SK
FIN AY
THY TK
LOT LO
TAP TP
EIN EI
BEL SN
ROT RO
ASL JU
CTN OU
RYR FR
EZY U2
WZZ W6
VLG VY
NAX DY
AAL AA
UAL UA
DAL DL
SWA WN
JBU B6
ASA AS
NKS NK
FFT F9
HAL HA
ACA AC
AMX AM
LAN LA
AVA AV
CMP CM
GLO G3
QFA QF
ANZ NZ
VOZ VA
JST JQ
ETH ET
SAA SA
MSR MS
KQA KQ
RAM AT
RWD WB
"""

# Leading digits of document numbers by airline.
NUMBER_PREFIXES = """
6E 890
AI 098
UK 228
SG 902
EK 176
QR 157
QP 141
IX 018
SQ 618
BA 125
LH 220
EY 607
"""

# Three-letter words that are no airport codes, and some longer ones that are no names.
STOPWORDS = """
THE
FOR
AND
ARE
NOT
YOU
YOUR
THIS
THAT
WAS
WITH
MAY
JUN
JUL
AUG
SEP
OCT
NOV
DEC
MON
TUE
WED
THU
FRI
SAT
SUN
NON
ANY
OUT
DUE
AIR
PNR
GST
BAG
PAY
REF
TAX
FEE
NET
SRV
MRN
HRS
APP
OLD
NEW
WAY
MMT
FTI
HAS
WON
END
"""

# Words by which a text shows where it was booked, first match first.
PLATFORMS = (("MAKEMYTRIP", "MakeMyTrip"), ("CLEARTRIP", "Cleartrip"), ("GOIBIBO", "Goibibo"), ("PAYTM", "Paytm"))

# Words of travel papers that decide which texts and lines count.
RELEVANT = ("BOOKING", "TICKET", "PNR", "TRAVELLER", "TRAVELER", "BOARDING")
NO_NAME_LINE = ("IMPORTANT", "PLEASE", "CARRY", "SECURITY", "CHECK-IN", "BOOKING", "ITINERARY", "E-TICKET", "TRIP", "ROUTE", "SEGMENT", "FARE", "PAYMENT", "AMOUNT")
HEAD_LINE = ("PASSENGER", "TRAVELLER", "TRAVELER", "GUEST")
SEGMENT_LINE = ("FROM", "TO", "DEPART", "ARRIV", "FLIGHT", "SECTOR", "ROUTE", "PNR")

# The fields of a traveller, as forms name them; the one of the document's number.
DOCUMENT_FIELD = "ticket_no"
TRAVELLER_FIELDS = ("name", DOCUMENT_FIELD, "passport", "dob", "doe", "seat", "meal", "checkin_bag", "hand_bag")

AIRPORT_SCHEMA = "code string, city string, airport string, country string, ord int"


def airline_rows() -> list[tuple[str, str]]:
    return [tuple(line.split(" ", 1)) for line in AIRLINES.strip().split("\n")]


def alias_rows() -> list[tuple[str, str]]:
    return [tuple(line.split()) for line in AIRLINE_ALIASES.strip().split("\n")]


def airlines(spark: SparkSession) -> DataFrame:
    """iata, name."""
    return spark.createDataFrame(airline_rows(), "iata string, name string")


def airline_aliases(spark: SparkSession) -> DataFrame:
    """alias, iata."""
    return spark.createDataFrame(alias_rows(), "alias string, iata string")


def prefix_rows() -> list[tuple[str, str]]:
    return [tuple(line.split()) for line in NUMBER_PREFIXES.strip().split("\n")]


def number_prefixes(spark: SparkSession) -> DataFrame:
    """iata, prefix; prefixes keep their leading zeros."""
    return spark.createDataFrame(prefix_rows(), "iata string, prefix string")


def airline_payload(spark: SparkSession) -> DataFrame:
    """code, name, iata, alias_of: airlines, and the aliases whose airline exists.

    A fixed table of under 200 rows, so joins may broadcast it."""
    base = airlines(spark).select(F.col("iata").alias("code"), "name", "iata")
    alias = airline_aliases(spark).join(airlines(spark), "iata").select(F.col("alias").alias("code"), "name", "iata", F.col("iata").alias("alias_of"))
    return base.unionByName(alias, allowMissingColumns=True)


def airports(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Airport dimension (code, city, airport, country, ord) from Parquet or a CSV
    with header; without a path a small invented-use sample of real codes.

    ``ord`` is the order of the source and breaks ties in searches."""
    if path:
        found = spark.read.csv(path, header=True, schema=AIRPORT_SCHEMA) if path.endswith(".csv") else spark.read.parquet(path)
        return found.select("code", "city", "airport", F.coalesce("country", F.lit("")).alias("country"), "ord")
    sample = (
        "DEL|Delhi|Indira Gandhi International|India", "BOM|Mumbai|Chhatrapati Shivaji Maharaj International|India",
        "HYD|Hyderabad|Rajiv Gandhi International|India", "BLR|Bengaluru|Kempegowda International|India",
        "DXB|Dubai|Dubai International|UAE", "LHR|London|Heathrow|United Kingdom", "SIN|Singapore|Changi|Singapore",
        "CDG|Paris|Charles de Gaulle|France", "DED|Dehradun|Jolly Grant|India", "JFK|New York|John F Kennedy|United States",
    )
    return spark.createDataFrame([(*line.split("|"), i) for i, line in enumerate(sample)], AIRPORT_SCHEMA)
