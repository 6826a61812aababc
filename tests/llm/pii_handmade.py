"""Sentences written by hand, kept apart from the training's phrases; items stand as {kind|item}."""

SENTENCES = [
    "{person|John Smith} was appointed head of compliance on Monday.",
    "After the break {person|Michael Jordan} scored eleven points in a row.",
    "{person|Maria Gonzalez} and {person|Robert Johnson} founded the company in 2011.",
    "The committee thanked {person|Alice Bennett} for her report.",
    "My landlord {person|George Whitfield} still has not returned the deposit.",
    "Please forward the invoice to {email|anna.keller@uni-bremen.de} before Friday.",
    "If the link is dead write me: {email|t_brooks1984@outlook.com}",
    "Send your CV to {email|jobs [at] northwind [dot] org} with two references.",
    "Our office line is {phone|+44 20 7946 0958}, ask for the night desk.",
    "You can reach the clinic on {phone|(415) 867-5309} until six.",
    "Missed a call from {phone|617-555-0142} again, anyone know who it is?",
    "His social security number is {id_number|123-45-6789}, do not share it.",
    "The form wants the passport number, mine is {id_number|C4829173}.",
    "We moved to {address|48 Maple Avenue, Springfield, IL 62704} last spring.",
    "The parcel was left at {address|221B Baker Street} by mistake.",
    "Court records list {address|Flat 7, 19 Harbour Road} as the registered home.",
    "A letter for {person|Samuel Okafor} came to {address|12 Kingsley Close} today.",
    "Contact {person|Priya Patel}, {phone|+1 212 555 0187}, for the keys.",
    "Ông {person|Trần Văn Hùng} khẳng định không biết gì về khoản tiền này.",
    "Bà {person|Lê Thị Thu Hà} đã gửi đơn tố cáo hôm qua.",
    "Theo lời {person|Nguyễn Quốc Bảo}, sàn đã khóa tài khoản từ tháng trước.",
    "Sáng nay {person|Phạm Minh Tuấn} bị tạm giữ để điều tra.",
    "Nhóm do {person|Đặng Ngọc Lan} và {person|Bùi Thanh Sơn} điều hành đã biến mất.",
    "Mình chuyển khoản cho {person|Hoàng Đức Anh} rồi mà chưa thấy hàng.",
    "Ai gặp sự cố thì gọi ngay {phone|0912 345 678} để được hướng dẫn.",
    "Số máy của kẻ lừa đảo: {phone|+84 987 654 321}, mọi người chặn đi.",
    "Shop giao nhanh, cần gì alo {phone|0387654321} nha cả nhà",
    "Nó bắt chụp căn cước {id_number|079204001234} gửi qua tin nhắn.",
    "Số CMND cũ {id_number|271 456 982} vẫn còn hiệu lực không ạ?",
    "Hộ chiếu {id_number|B7654321} bị mất ở sân bay.",
    "Kho hàng nằm ở {address|số 15 đường Lê Lợi, phường Bến Nghé, Quận 1} nhé.",
    "Gửi trả về {address|27/4 hẻm 12 phố Hàng Bông, P. Hàng Gai} giúp em.",
    "Công an đã khám xét nhà tại {address|102 ngõ 55 Trần Duy Hưng, Q. Cầu Giấy}.",
    "Hồ sơ gửi vào {email|hoso.tuyendung@congty.com.vn} trước thứ sáu.",
    "Khách hàng {person|Vũ Thị Mai}, sđt {phone|0903.123.456}, đã hủy đơn.",
    "goi cho minh so {phone|0976 112 233} nhe, minh la {person|Tran Thi Thao}",
    "email cua minh {email|lan.nguyen92@gmail.com}",
    "Liên hệ chị {person|Ngô Phương Thảo} qua {email|thao.ngo@hopthu.vn}",
    "Interview with {person|Elena Petrova} about the audit is out now.",
    "According to {person|David Chen}, the reserves were never checked.",
    # nothing to find
    "Visit New York City in the spring, the parks are lovely.",
    "The United States and South Korea signed a trade agreement on 2024-05-06.",
    "Order 4500123456 shipped on 12 March 2024 and should arrive on Tuesday.",
    "Invoice 20240017 for 1,250,000 USD is still unpaid.",
    "Bitcoin fell 3.5% to 61,240 dollars at 14:30:00 on Monday.",
    "The Federal Reserve raised rates by 25 basis points.",
    "Update to version 12.4.1 before block 840000 is mined.",
    "Tổng Giám đốc cho biết doanh thu quý 3 đạt 1.250 tỷ đồng.",
    "Ngân hàng Nhà nước sẽ công bố tỷ giá mới vào ngày 15/08/2024.",
    "Mã vận đơn 880123456789 chưa cập nhật, mọi người kiểm tra giúp.",
    "Hà Nội và Đà Nẵng có mưa lớn trong 24 giờ tới.",
    "Ví 0x52908400098527886E0F7030069857D2E4169EE7 vừa chuyển 300 ETH.",
    "theo dõi kênh @tinnhanh_vn để nhận tin sớm",
    "Hội đồng Quản trị sàn Kelmora họp lúc 09:00 ngày 2-11-2024.",
    "Wall Street opened higher after the jobs report.",
    "cảm ơn ad, bài viết rất hữu ích",
    "The Supreme Court will hear the case next Thursday.",
    "Season 4 episode 12 was the best, rated 9.1 by 120,000 people.",
    "Sở Giao dịch Chứng khoán tạm dừng 15 mã cổ phiếu.",
    "Ledger Labs and Orion Capital merged their custody business.",
]

# written after the last training and measured once
FRESH = [
    "The coach, {person|Marcus Delgado}, left the club after two seasons.",
    "Police arrested {person|Tanya Novak} at the airport last night.",
    "{person|William Osei} and {person|Grace Lindqvist} share the prize this year.",
    "Someone named {person|Oscar Feldman} keeps calling from {phone|(503) 294-7718}.",
    "For refunds write to {email|billing.support@parcelhub.co.uk} or phone {phone|0161 496 0000}.",
    "I lost my wallet near {address|310 Cedar Street}, call {phone|+1 303-555-0170} if you find it.",
    "Attached is a copy of my passport, number {id_number|K1938274}.",
    "They asked for my SSN, {id_number|508-22-7719}, over the phone!",
    "Old tenants of {address|Unit 5, 77 Station Road, Leeds} still get mail there.",
    "Yesterday {person|Hassan Yilmaz} explained how the bridge was drained.",
    "Tòa tuyên {person|Lý Hoàng Nam} mười hai năm tù.",
    "Cô {person|Đỗ Mỹ Linh} dạy toán ở trường cũ của em.",
    "Người đứng ra thu tiền là {person|Võ Thành Trung}, ai cũng biết mặt.",
    "Liên lạc trực tiếp: {phone|0868.909.808} (Hải)",
    "Em ghi căn cước {id_number|001302004567} vào tờ khai rồi ạ.",
    "Thư mời đã gửi tới {email|phongnhansu@hoaphat.vn} sáng nay.",
    "Đoàn kiểm tra đến {address|số 8 đường Nguyễn Trãi, phường Thượng Đình, Thanh Xuân} lúc chín giờ.",
    "Bạn nào cần thì ib, không thì gọi {phone|+84 905 667 788}",
    "ban cho {person|Pham Thi Hoa} so dien thoai {phone|0934556677} nhe",
    "Nhờ chuyển lời tới {person|Trương Quốc Khánh} giúp anh.",
    "The European Union fined three exchanges a total of 45,000,000 euros.",
    "Flight VN123 departs at 06:45 on 3 July 2025 from gate 14.",
    "Los Angeles and San Francisco expect record heat this weekend.",
    "Serial 884213097755 belongs to the old batch of devices.",
    "Chứng khoán phiên 21/10/2024 tăng 12,5 điểm, thanh khoản đạt 15.300 tỷ đồng.",
    "Bộ Tài chính đề xuất giảm 30% thuế trước bạ.",
    "Quỹ Morgrave Capital và sàn Teldora chưa phản hồi.",
    "Hợp đồng số 20231108 hết hạn vào cuối tháng.",
    "Happy New Year to everyone in the group!",
    "The Great Wall attracts ten million visitors a year.",
]
