"""Configuration patterns: TLS, SSH, JWT, OpenSSL and PEM settings."""

from __future__ import annotations

from cryptoscape.operators.patterns import Pattern

# Fixed values, in the order they are tried:
# (file class, algorithm, ignore case, regex, words a matching line holds, line text)
_RULES = (
    ("tls", "TLS-1.0", True, r"ssl_protocols\s+.*\bTLSv1\b(?!\.)",
     ("ssl_protocols", "tlsv1"), "nginx TLS 1.0 enabled"),
    ("tls", "TLS-1.1", True, r"ssl_protocols\s+.*\bTLSv1\.1\b",
     ("ssl_protocols", "tlsv1.1"), "nginx TLS 1.1 enabled"),
    ("tls", "TLS-1.0", True, r"SSLProtocol\s+.*\+?TLSv1\b(?!\.)",
     ("sslprotocol", "tlsv1"), "Apache TLS 1.0 enabled"),
    ("tls", "TLS-1.0", True, r"ssl-min-ver\s+TLSv1\.0",
     ("ssl-min-ver", "tlsv1.0"), "HAProxy TLS 1.0 minimum version"),
    ("tls", "TLS-1.0", True, r"MinProtocol\s*=\s*TLSv1\b(?!\.)",
     ("minprotocol", "tlsv1"), "OpenSSL TLS 1.0 minimum protocol"),
    ("env", "TLS-1.0", False, r"TLS_VERSION\s*=\s*1\.0\b",
     ("tls_version", "1.0"), "TLS 1.0 configured in environment"),
    ("ssh_key", "SSH-RSA", False, r"^ssh-rsa\s", ("ssh-rsa",), "SSH RSA public key"),
    ("ssh_key", "DSA", False, r"^ssh-dss\s", ("ssh-dss",), "SSH DSA public key"),
    ("ssh_key", "ECDSA", False, r"^ecdsa-sha2-nistp\d+\s", ("ecdsa-sha2-nistp",),
     "SSH ECDSA public key"),
    ("ssh_key", "Ed25519", False, r"^ssh-ed25519\s", ("ssh-ed25519",), "SSH Ed25519 public key"),
    ("ssh_daemon", "3DES", True, r"Ciphers\s+.*3des", ("ciphers", "3des"),
     "3DES cipher enabled in SSH config"),
    ("ssh_daemon", "AES-128", True, r"Ciphers\s+.*aes128", ("ciphers", "aes128"),
     "AES-128 cipher enabled in SSH config"),
    ("ssh_daemon", "HMAC-SHA1", True, r"MACs\s+.*hmac-sha1\b", ("macs", "hmac-sha1"),
     "HMAC-SHA1 MAC enabled in SSH config"),
    ("ssh_daemon", "DH", True, r"KexAlgorithms\s+.*diffie-hellman",
     ("kexalgorithms", "diffie-hellman"), "Diffie-Hellman key exchange in SSH config"),
    ("jwt", "JWT-RS256", True, r"(?:algorithm|alg)[\"'\s:=]+RS256", ("alg", "rs256"),
     "JWT RS256 algorithm configured"),
    ("jwt", "JWT-ES256", True, r"(?:algorithm|alg)[\"'\s:=]+ES256", ("alg", "es256"),
     "JWT ES256 algorithm configured"),
    ("env", "JWT-RS256", False, r"JWT_ALGORITHM\s*=\s*RS256\b", ("jwt_algorithm", "rs256"),
     "JWT RS256 algorithm in environment"),
    ("openssl", "SHA-1", True, r"default_md\s*=\s*sha1\b", ("default_md", "sha1"),
     "OpenSSL default digest set to SHA-1"),
    ("openssl", "MD5", True, r"default_md\s*=\s*md5\b", ("default_md", "md5"),
     "OpenSSL default digest set to MD5"),
    ("openssl", "RSA", False, r"default_bits\s*=\s*(?:512|1024|2048)\b", ("default_bits",),
     "RSA key size configured in OpenSSL"),
    ("pem", "RSA", False, r"-----BEGIN RSA PRIVATE KEY-----",
     ("-----begin rsa private key-----",), "RSA private key in PEM format"),
    ("pem", "DSA", False, r"-----BEGIN DSA PRIVATE KEY-----",
     ("-----begin dsa private key-----",), "DSA private key in PEM format"),
    ("pem", "ECDSA", False, r"-----BEGIN EC PRIVATE KEY-----",
     ("-----begin ec private key-----",), "ECDSA private key in PEM format"),
)


def config_patterns() -> list[Pattern]:
    """The patterns with the Unicode classes that ``\\s``, ``\\b`` and ``\\d`` stand for."""
    return [
        Pattern(algorithm_id, "config", file_class, ("(?iU)" if ignore_case else "(?U)") + regex,
                words, line_text)
        for file_class, algorithm_id, ignore_case, regex, words, line_text in _RULES
    ]
