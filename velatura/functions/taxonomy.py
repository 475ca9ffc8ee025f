"""The label taxonomy: one table for every place that maps, drops or admits labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The final labels of the taxonomy; URL comes from rules only.
FINAL = (
    "FULLNAME", "AGE", "GENDER", "DATE", "TIME", "STREET", "BUILDINGNUM", "ZIPCODE", "CITY", "PROVINCE", "EMAIL", "TELEPHONENUM",
    "CF", "PIVA", "ID_DOC", "IBAN", "CREDITCARDNUMBER", "AMOUNT", "TARGA", "ORG", "DOCID", "CATASTO",
)
RULE_ONLY = ("URL",)
#: Raw labels and the final label of each.
RAW_TO_FINAL = {
    "GIVENNAME": "FULLNAME", "SURNAME": "FULLNAME", "GIUDICE": "FULLNAME", "AVVOCATO": "FULLNAME", "CONVENUTO": "FULLNAME",
    "ATTORE": "FULLNAME", "TESTIMONE": "FULLNAME", "SEX": "GENDER", "TAXNUM": "PIVA", "PEC": "EMAIL", "RG": "DOCID",
    "IDCARDNUM": "ID_DOC", "PASSPORTNUM": "ID_DOC", "DRIVERLICENSENUM": "ID_DOC", "SOCIALNUM": "ID_DOC", "CONTO": "IBAN",
    "CIG": "DOCID", "CUP": "DOCID", "POLIZZA": "DOCID", "MATRICOLA": "DOCID",
}
#: Labels that stand for nothing personal.
DROPPED = ("TITLE", "TRIBUNAL")
#: Labels of the span-labelled corpus; all others are dropped.
SPAN_CORPUS = {
    "FIRSTNAME": "FULLNAME", "LASTNAME": "FULLNAME", "MIDDLENAME": "FULLNAME", "EMAIL": "EMAIL", "PHONENUMBER": "TELEPHONENUM",
    "IBAN": "IBAN", "ACCOUNTNUMBER": "IBAN", "CREDITCARDNUMBER": "CREDITCARDNUMBER", "AMOUNT": "AMOUNT", "DATE": "DATE", "DOB": "DATE",
    "TIME": "TIME", "AGE": "AGE", "GENDER": "GENDER", "SEX": "GENDER", "STREET": "STREET", "BUILDINGNUMBER": "BUILDINGNUM",
    "ZIPCODE": "ZIPCODE", "CITY": "CITY", "COMPANYNAME": "ORG", "SSN": "ID_DOC", "VEHICLEVRM": "TARGA",
}
#: Labels whose words a name's case may change in.
RECASED = ("FULLNAME", "STREET", "CITY", "PROVINCE", "ORG")
ADMITTED = (*FINAL, *RAW_TO_FINAL)


def mapping(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def final_label(label: Column) -> Column:
    """The final label of a raw one; null if it is dropped; labels outside the table stay."""
    return F.when(label.isin(*DROPPED), F.lit(None).cast("string")).otherwise(F.coalesce(F.element_at(mapping(RAW_TO_FINAL), label), label))
