"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

TAG = _struct(tagFQN=_S, description=_S, source=_S, labelType=_S, state=_S, href=_S)

CONTRACT_COLUMN = _struct(
    name=_S,
    dataType=_S,
    dataLength=_I,
    constraint=_S,
    precision=_I,
    scale=_I,
    description=_S,
    tags=T.ArrayType(TAG),
)

DATA_CONTRACT = _struct(schema=T.ArrayType(CONTRACT_COLUMN))

# Free-form parts of a descriptor stay JSON text: from_json keeps the raw
# document when an object is read into a string field.
COMPONENT = _struct(
    kind=_S,
    id=_S,
    name=_S,
    fullyQualifiedName=_S,
    description=_S,
    useCaseTemplateId=_S,
    infrastructureTemplateId=_S,
    specific=_S,
    version=_S,
    dependsOn=T.ArrayType(_S),
    platform=_S,
    technology=_S,
    outputPortType=_S,
    creationDate=_S,
    startDate=_S,
    retentionTime=_S,
    processDescription=_S,
    dataContract=DATA_CONTRACT,
    dataSharingAgreement=_S,
    tags=T.ArrayType(TAG),
    sampleData=_S,
    semanticLinking=_S,
    workloadType=_S,
    connectionType=_S,
    readsFrom=T.ArrayType(_S),
    storageType=_S,
    endpoint=_S,
    completeness=_S,
    dataProfiling=_S,
    freshness=_S,
    availability=_S,
    dataQuality=_S,
)

DATA_PRODUCT = _struct(
    id=_S,
    name=_S,
    fullyQualifiedName=_S,
    description=_S,
    kind=_S,
    domain=_S,
    version=_S,
    environment=_S,
    dataProductOwner=_S,
    dataProductOwnerDisplayName=_S,
    email=_S,
    ownerGroup=_S,
    devGroup=_S,
    informationSLA=_S,
    status=_S,
    maturity=_S,
    billing=_S,
    tags=T.ArrayType(TAG),
    specific=_S,
    components=T.ArrayType(COMPONENT),
)

DESCRIPTOR = _struct(dataProduct=DATA_PRODUCT, componentIdToProvision=_S)

COLUMN_INVENTORY = _struct(
    table_name=_S,
    pos=_I,
    column_name=_S,
    type_name=_S,
    type_text=_S,
    type_precision=_I,
    type_scale=_I,
    nullable=_B,
    comment=_S,
)

STATUS_EVENT = _struct(
    task_id=_S, seq=T.LongType(), op=_S, status=_S, result=_S, info=_S
)
