"""Owner signatures: ECDSA over P-256 with SHA-256, through the JVM that Spark runs in."""

from __future__ import annotations

import base64

from pyspark.sql import SparkSession

ALGORITHM = "SHA256withECDSAinP1363Format"


def new_keys(spark: SparkSession) -> tuple[str, str]:
    """(public, private), base64."""
    security = spark.sparkContext._jvm.java.security
    maker = security.KeyPairGenerator.getInstance("EC")
    maker.initialize(security.spec.ECGenParameterSpec("secp256r1"))
    pair, factory = maker.generateKeyPair(), security.KeyFactory.getInstance("EC")
    kind = spark.sparkContext._jvm.java.lang.Class.forName
    specs = (
        factory.getKeySpec(pair.getPublic(), kind("java.security.spec.X509EncodedKeySpec")),
        factory.getKeySpec(pair.getPrivate(), kind("java.security.spec.PKCS8EncodedKeySpec")),
    )
    return tuple(base64.b64encode(bytes(s.getEncoded())).decode() for s in specs)


def sign(spark: SparkSession, private_key: str, message: str) -> str:
    security = spark.sparkContext._jvm.java.security
    key = security.KeyFactory.getInstance("EC").generatePrivate(security.spec.PKCS8EncodedKeySpec(bytearray(base64.b64decode(private_key))))
    signer = security.Signature.getInstance(ALGORITHM)
    signer.initSign(key)
    signer.update(bytearray(message.encode()))
    return bytes(signer.sign()).hex()


def verify(spark: SparkSession, public_key: str, message: str, signature: str) -> bool:
    security = spark.sparkContext._jvm.java.security
    key = security.KeyFactory.getInstance("EC").generatePublic(security.spec.X509EncodedKeySpec(bytearray(base64.b64decode(public_key))))
    verifier = security.Signature.getInstance(ALGORITHM)
    verifier.initVerify(key)
    verifier.update(bytearray(message.encode()))
    try:
        return bool(verifier.verify(bytearray(bytes.fromhex(signature))))
    except Exception:  # malformed signatures
        return False
