"""Lists and names that results depend on, in natural order."""

# Networks that are local, for documentation, and never unicast hosts.
LOCAL_NETS = ["10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/4"]
TEST_NETS = ["192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24"]
NOISE_NETS = ["127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/4", "240.0.0.0/4"]

# Ports of discovery noise, long idle channels and internal services.
NOISE_PORTS = [67, 68, 123, 1900, 3478, 5228, 5353, 5355, 5678]
LONG_IDLE_PORTS = [25, 53, 110, 143, 465, 587, 993, 995, 1633, 3478, 5060, 5222, 5223, 5228, 5944, 6667, 6697, 51820]
INTERNAL_SERVICE_PORTS = [
    53, 67, 68, 69, 88, 102, 110, 111, 123, 135, 137, 138, 139, 143, 161, 162, 177, 389, 427, 443, 445, 464, 465, 500,
    514, 520, 546, 547, 554, 587, 593, 631, 636, 646, 873, 989, 990, 1025, 1026, 1194, 1433, 1434, 1512, 1513, 1521,
    1723, 1900, 2049, 2404, 3128, 3268, 3269, 3306, 3389, 3478, 3690, 5060, 5222, 5350, 5351, 5352, 5353, 5354, 5355,
    5432, 5672, 5900, 5985, 5986, 5988, 6379, 6666, 6667, 6668, 6669, 6697, 7001, 7002, 8000, 8009, 8080, 8081, 8082,
    8083, 8088, 8118, 8443, 8472, 8883, 9090, 9100, 9200, 9300, 9418, 9999, 10000, 10009, 10050, 11211, 27017, 28017,
    41641, 45000, 45001, 50000, 51820,
]

# Domains whose long random labels are normal.
KNOWN_GOOD_PARENTS = [
    "akamai.net", "akamaiedge.net", "akamaihd.net", "amazonaws.com", "apple.com", "azureedge.net", "cloudflare.com",
    "cloudflare.net", "cloudfront.net", "edgekey.net", "edgesuite.net", "fastly.net", "fbcdn.net", "google.com",
    "googleapis.com", "googleusercontent.com", "gstatic.com", "icloud.com", "microsoft.com", "office.com", "windows.net",
]

# Networks whose traffic is large and periodic.
PROVIDER_ASNS = [
    "AS3078", "AS3257", "AS3598", "AS4641", "AS8068", "AS8075", "AS8987", "AS11427", "AS12876", "AS13335", "AS14061",
    "AS14618", "AS15133", "AS15169", "AS16265", "AS16276", "AS16509", "AS16510", "AS16625", "AS17493", "AS19047",
    "AS19165", "AS19807", "AS20001", "AS20473", "AS20940", "AS24940", "AS26302", "AS31898", "AS32934", "AS36459",
    "AS38895", "AS51167", "AS54113", "AS55030", "AS60781", "AS63949", "AS135630", "AS157359", "AS202425", "AS207812",
    "AS394711", "AS396982", "AS399358",
]

# Header spellings of flow tables, first match wins.
CSV_ALIASES = {
    "src_ip": ["source ip", "src ip", "srcip", "src_ip", "sourceip", "id.orig_h", "src", "source address"],
    "src_port": ["source port", "src port", "srcport", "src_port", "id.orig_p", "sport"],
    "dst_ip": ["destination ip", "dst ip", "dstip", "dst_ip", "destinationip", "id.resp_h", "dst", "destination address"],
    "dst_port": ["destination port", "dst port", "dstport", "dst_port", "id.resp_p", "dport"],
    "proto": ["protocol", "proto"],
    "ts": ["timestamp", "ts", "time", "datetime"],
    "orig_bytes": ["total length of fwd packets", "totlen fwd pkts", "orig_bytes", "orig_ip_bytes", "fwd bytes", "subflow fwd bytes", "total fwd bytes"],
    "resp_bytes": ["total length of bwd packets", "totlen bwd pkts", "resp_bytes", "resp_ip_bytes", "bwd bytes", "subflow bwd bytes", "total bwd bytes"],
    "duration": ["flow duration", "duration"],
    "syn": ["syn flag count", "syn"],
    "ack": ["ack flag count", "ack"],
    "fin": ["fin flag count", "fin"],
    "rst": ["rst flag count", "rst"],
    "query": ["query", "dns_query", "dns query"],
    "label": ["label", "class"],
    "flow_rate": ["flow packets/s"],
}

# Classes, and the nearest class of public data sets' labels.
THREATS = ["c2_beaconing", "ddos", "dga_dns_tunnel", "encrypted_malware", "exfiltration", "recon_scan"]
SEVERITIES = ["low", "medium", "high", "critical"]
LABEL_CLASSES = {
    "benign": None, "bot": "c2_beaconing", "ddos": "ddos", "dos goldeneye": "ddos", "dos hulk": "ddos",
    "dos slowhttptest": "ddos", "dos slowloris": "ddos", "ftp-patator": "recon_scan", "heartbleed": "encrypted_malware",
    "infiltration": "exfiltration", "portscan": "recon_scan", "ssh-patator": "recon_scan", "web attack": None,
}

# Fields that each detector needs, and columns that carry a field.
REQUIRED_FIELDS = {
    "ddos": ["src_ip", "dst_ip", "proto", "tcp_flags/conn_state"],
    "c2_beaconing": ["src_ip", "dst_ip", "timestamp"],
    "dga_dns_tunnel": ["dns_query"],
    "encrypted_malware": ["tls_ja3/sni", "src_ip", "orig_bytes", "resp_bytes"],
    "recon_scan": ["src_ip", "dst_port"],
    "exfiltration": ["src_ip", "dst_ip", "orig_bytes"],
}
FIELD_COLUMNS = {
    "src_ip": ["source ip", "src ip"], "dst_ip": ["destination ip", "dst ip"], "src_port": ["source port", "src port"],
    "dst_port": ["destination port", "dst port"], "proto": ["protocol"], "timestamp": ["timestamp"],
    "dns_query": ["query", "dns_query"], "tls_ja3/sni": ["ja3", "sni"], "tcp_flags/conn_state": ["flow id"],
    "orig_bytes": ["fwd packets length total"], "resp_bytes": ["bwd packets length total"],
}

# Time formats of flow tables, tried in this order.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSSSSS", "d/M/yyyy H:m", "d/M/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy H:m:s"]
