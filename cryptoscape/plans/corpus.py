"""The corpus table of the registered queries, made from the given tables.

Every document becomes one file: its text and, after it, snippets as one finds
them in a repository. Its path depends on the id, so all file kinds, directories
and snippets occur together. The same arithmetic is written in SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cryptoscape.functions.text import quote

DIRECTORIES = ("src/", "tests/", "docs/", "vendor/lib/", "legacy/auth/", "web/__tests__/",
               "pkg/core/", "build/out/", "lib/crypto.egg-info/", "app/", "spec/", "cmd/",
               "internal/tls/")

SNIPPETS = {
    "hash": "import hashlib\nh = hashlib.md5(data) + hashlib.sha1(x)\n# old: RSA_PKCS1_PADDING\n",
    "sign": "key = RSA.generate(2048)\nsig = key.sign(msg, 'SHA-512')\n  // uses ecdsa_sign over P-384\n",
    "node": "const c = createCipheriv('aes-128-cbc', k, iv);\nconst h = createHash('sha256');\n",
    "mixed": "cipher = TripleDES(DESede)\nrequire('bcrypt')\ncurve = Curve25519; X448\n",
    "tls": "ctx.minimum = TLSv1_2\nproto: TLS_1_0 and SSLv3 or tls1.1\n\nRS256, ES256 or HS512\n",
    "mac": "mac = hmac.new(key, msg, sha1)\nHMAC-SHA256 with hmac_sha256\npbkdf2_hmac('sha256')\n",
    "kdf": "/* Argon2id or scrypt */\nchacha20-poly1305\n* Blowfish bf-cbc\nfrom Crypto import ARC4\n",
    "strong": "AES-256-GCM or aes_192, camellia\nSHA3 and Keccak, blake2b, SHA-384, sha_224\nTLSv1.3\n",
    "curves": "ECDH over Ed448 or ElGamal\ndsa_verify and RIPEMD160\nnew DiffieHellman (x)\n",
    "nginx": "ssl_protocols TLSv1 TLSv1.1 TLSv1.2;\nSSLProtocol all +TLSv1\nssl-min-ver TLSv1.0\n",
    "sshd": "Ciphers aes128-ctr,3des-cbc\nMACs hmac-sha1,hmac-md5\nKexAlgorithms diffie-hellman-x\n",
    "openssl": "[ req ]\ndefault_bits = 2048\ndefault_md = sha1\nMinProtocol = TLSv1\ndefault_md=MD5\n",
    "env": "TLS_VERSION=1.0\nJWT_ALGORITHM = RS256\nTLS_VERSION=1.01\n",
    "jwt": 'auth:\n  algorithm: "RS256"\n  alg = ES256\n  "alg": "HS256"\n',
    "requirements": "cryptography==42.0  # pinned\npycryptodome>=3\n-r other.txt\n"
                    "bcrypt[x]; python_version\n\nParamiko ~= 3\npynacl\nrequests @ url\n",
    "pipfile": '[packages]\njose = "*"\n"passlib" = "1"\n[dev-packages]\n\'pyopenssl\' = "*"\n'
               '[requires]\nbcrypt = "1"\n',
    "pyproject": '[project]\ndependencies = ["cryptography>=1", "paramiko"]\n"pynacl"\n]\n"bcrypt"\n'
                 '[tool.poetry.dependencies]\npython = "3"\npasslib = "^1"\n'
                 "[project.optional-dependencies]\nx = ['jose', \"tweetnacl\"]\n",
    "cargo": '[dependencies]\nbcrypt = "0.1"\n[dev-dependencies]\njose = { version = "1" }\n'
             '[profile]\ntweetnacl = "1"\n',
    "gomod": "require (\n  golang.org/x/bcrypt v1\n  // note\n\n  jose v2\n)\n"
             "require github.com/a/node-forge v1\n",
    "pom": "<artifactId> bcrypt </artifactId>\n<artifactId>jose</artifactId><artifactId>x</artifactId>\n",
    "gradle": "implementation 'org.x:bcrypt:1'\ncompile \"a:node-forge:2\"\nruntime project(':b')\n",
    "key": "ssh-rsa AAAAB3 me\nssh-dss AAAA\n ssh-rsa no\necdsa-sha2-nistp256 AA\nssh-ed25519 AA\n",
    "pem": "-----BEGIN RSA PRIVATE KEY-----\nx\n-----BEGIN EC PRIVATE KEY-----\n"
           "-----BEGIN DSA PRIVATE KEY-----\n",
    "plain": "a plain line\nuse universal versatile designs for 256 shapes\n",
}

# File name, {id} being the number of the document, and the snippet that fits its kind.
# Every file has that one and another one, so wrong places are tried as well.
FILES = {
    "f{id}.py": "hash", "f{id}.ts": "node", "F{id}.java": "curves", "test_f{id}.go": "sign",
    "svc{id}/requirements.txt": "requirements", "svc{id}/package.json": "plain",
    "svc{id}/nginx.conf": "nginx", "svc{id}/sshd_config": "sshd",
    "svc{id}/pyproject.toml": "pyproject", "svc{id}/openssl.cnf": "openssl", "svc{id}/.env": "env",
    "svc{id}/Cargo.toml": "cargo", "svc{id}/settings.yaml": "jwt", "f{id}.md": "plain",
    "svc{id}/go.mod": "gomod", "svc{id}/Pipfile": "pipfile", "svc{id}/pom.xml": "pom",
    "svc{id}/build.gradle": "gradle", "svc{id}/id.pub": "key", "svc{id}/server.pem": "pem",
    "README{id}.rb": "mac", "f{id}.min.js": "strong", "svc{id}/config.json": "jwt",
}

# A package.json is valid JSON only without prose, so the prose is one of its values.
PACKAGE_JSON = (
    '{{\n "name": "p",\n "text": {text},\n "dependencies": {{\n  "bcrypt": "1",\n  "left": "2"\n }},'
    '\n "devDependencies": {{ "crypto-js": "4", "bcrypt": "1" }},\n "auth": {{ "alg": "RS256" }}\n}}'
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str] | tuple[str, ...], number: Column) -> Column:
    literal = F.expr("array(" + ", ".join(quote(v) for v in values) + ")")
    return F.get(literal, (number % len(values)).cast("int"))


# A repository without a finding.
CLEAN = "src7"

# What some files have besides: by the rest of the document's number by 11.
ODD_LINES = {
    3: "dos MD5\r\n\r\nx\r\r\nuse MD5 here\rSHA-1\r\n",
    5: "\fRSA \x0b page\u2028SHA-1 \x1c end\x85DES3\u2029\x1d\x1e last\n",
}
# The same with bytes that are not UTF-8, as hexadecimal digits.
BROKEN = {7: "fffe204d44352063 6166c30a".replace(" ", "")}
EARLY_NUL, LATE_NUL, LATE_PAD = 9, 10, 2100

# Every seventh package.json repeats a section and has numbers that only some readers accept.
ODD_JSON = ', "n": [NaN, -Infinity], "dependencies": { "jose": "1", "left": "2", "jose": "3" }}'


def planted(documents: DataFrame, shift: Column | int = 0, move: Column | int = 0) -> DataFrame:
    """``repo, path, content`` of the documents; the repository is the source.

    ``shift`` moves on to another snippet and ``move`` to another directory,
    which gives another state of the same repositories.
    """
    number, clean = F.col("doc_id"), F.col("source") == CLEAN
    rest = number % 11
    name = F.when(clean, F.concat(F.lit("f"), number, F.lit(".py"))).otherwise(
        F.replace(_pick(list(FILES), number), F.lit("{id}"), number.cast("string")))
    fitting = _pick([SNIPPETS[kind] for kind in FILES.values()], number)
    other = _pick(list(SNIPPETS.values()), number + shift)
    opening, closing = (F.lit(p.replace("{{", "{").replace("}}", "}"))
                        for p in PACKAGE_JSON.split("{text}"))
    escaped = F.to_json(F.struct(F.col("text").alias("t")))
    json_text = F.concat(opening, F.substr(escaped, F.lit(6), F.length(escaped) - 6), closing)
    json_text = F.when(number % 7 == 0, F.concat(
        F.left(json_text, F.length(json_text) - 1), F.lit(ODD_JSON))).otherwise(json_text)
    body = F.concat("text", F.lit("\n"), fitting, other)
    for r, lines in ODD_LINES.items():
        body = F.when(rest == r, F.concat(body, F.lit(lines))).otherwise(body)
    body = (F.when(rest == EARLY_NUL, F.concat(F.lit("\0"), body))
            .when(rest == LATE_NUL, F.concat(body, F.repeat(F.lit("pad "), LATE_PAD),
                                             F.lit("\0\nMD5 after\n"))).otherwise(body))
    raw = body.cast("binary")
    for r, digits in BROKEN.items():
        raw = F.when(rest == r, F.concat(raw, F.unhex(F.lit(digits)))).otherwise(raw)
    content = F.when(clean, F.col("text").cast("binary")).when(
        name.endswith("package.json"), json_text.cast("binary")).otherwise(raw)
    return documents.select(
        F.col("source").alias("repo"),
        F.concat(_pick(DIRECTORIES, number + move), name).alias("path"),
        content.alias("content"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prose tables as source files, for catalogues of the user's own."""
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("repo"),
        F.concat(F.lit("d"), F.col("doc_id"), F.lit(".py")).alias("path"),
        F.col("text").alias("content"))
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("repo"),
        F.concat(F.lit("p"), F.col("page_id"), F.lit(".js")).alias("path"),
        F.col("html").alias("content"))
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("repo"),
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("/t"), F.col("turn"), F.lit(".rb"))
        .alias("path"),
        F.col("text").alias("content"))
    return documents.unionByName(pages).unionByName(turns)
